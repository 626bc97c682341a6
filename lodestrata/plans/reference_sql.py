"""SQL of the record, code and text stages, as common table expressions for DuckDB."""

from __future__ import annotations

_FORMATS = "['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%Y/%m/%d', '%Y.%m.%d', '%Y%m%d', '%Y-%m']"


def date(c: str) -> str:
    return f"try_strptime(trim({c}), {_FORMATS})::date"


def quarter(c: str) -> str:
    return f"(year({c})::varchar || 'Q' || quarter({c})::varchar)"


def qord(c: str) -> str:
    return f"(year({c}) * 4 + quarter({c}) - 1)"


def qlabel(o: str) -> str:
    return f"(({o}) // 4)::varchar || 'Q' || ((({o}) % 4) + 1)::varchar"


def joined(c: str, sep: str = "; ") -> str:
    return f"coalesce(array_to_string(list_sort(list_distinct(list(nullif(trim({c}), '')))), '{sep}'), '')"


STOCK = """CASE WHEN regexp_extract(regexp_replace(regexp_replace(trim({c}), '[="'']', '', 'g'), '^([0-9]+)\\.0+$', '\\1'), '[0-9]{{1,6}}') <> ''
 THEN lpad(regexp_extract(regexp_replace(regexp_replace(trim({c}), '[="'']', '', 'g'), '^([0-9]+)\\.0+$', '\\1'), '[0-9]{{1,6}}'), 6, '0') END"""

_PADDED = "'^([A-H][0-9]{2}[A-Z])([0-9]{4})([0-9]{6})$'"
_DISPLAY = "'^([A-H][0-9]{2}[A-Z])([0-9]{1,4})/([0-9]{1,6})$'"


def _flat(raw: str) -> str:
    return rf"regexp_replace(replace(upper(regexp_replace({raw}, '\[[0-9]{{4}}\.[0-9]{{2}}\]', '', 'g')), '／', '/'), '\s+', '', 'g')"


def _code(t: str) -> str:
    tail = f"regexp_replace(regexp_extract({t}, {_PADDED}, 3), '0+$', '')"
    sub = f"try_cast(regexp_extract({t}, {_DISPLAY}, 3) AS int)"
    return f"""CASE WHEN regexp_matches({t}, '^[A-H]([0-9]{{2}}[A-Z]?)?$') THEN {t}
 WHEN regexp_matches({t}, {_PADDED}) THEN regexp_extract({t}, {_PADDED}, 1) || try_cast(regexp_extract({t}, {_PADDED}, 2) AS int)::varchar || '/' || rpad({tail}, greatest(2, length({tail}))::int, '0')
 WHEN regexp_matches({t}, {_DISPLAY}) THEN regexp_extract({t}, {_DISPLAY}, 1) || try_cast(regexp_extract({t}, {_DISPLAY}, 2) AS int)::varchar || '/' || lpad({sub}::varchar, greatest(2, length({sub}::varchar))::int, '0') END"""


_FLAG = r"'(?i)([A-H]\s*[0-9]{2}\s*[A-Z]\s*[0-9]{1,4}\s*/\s*[0-9]{1,6})[IN]$'"


def tokens(name: str, source: str, key: str, field: str, extra: str = "") -> str:
    """CTEs ``name``: key, raw, pos, code, status, sub of every token of a field."""
    keep = f", {extra}" if extra else ""
    return rf"""{name}_l AS (SELECT {key}{keep}, list_filter(list_transform(string_split_regex(coalesce({field}, ''), '[;；]'), lambda x: trim(x)), lambda x: x <> '') AS l FROM {source}),
{name}_u AS (SELECT {key}{keep}, unnest(l) AS raw, unnest(range(1, len(l) + 1)) AS pos FROM {name}_l),
{name}_n AS (SELECT *, {_flat('raw')} AS t1, {_flat(f"regexp_replace(raw, {_FLAG}, '\\1')")} AS t2 FROM {name}_u),
{name}_c AS (SELECT *, {_code('t1')} AS c1, {_code('t2')} AS c2 FROM {name}_n),
{name} AS (SELECT {key}{keep}, raw, pos, coalesce(c1, c2) AS code, CASE WHEN c1 IS NOT NULL THEN 'normalized' WHEN c2 IS NOT NULL THEN 'suffix_stripped' ELSE 'unmatched' END AS status,
 CASE WHEN regexp_matches(left(coalesce(c1, c2), 4), '^[A-H][0-9]{{2}}[A-Z]$') THEN left(coalesce(c1, c2), 4) END AS sub FROM {name}_c)"""


_PLAIN = ["stkcd_raw", "company_name", "relation", "applicant", "applicant_type", "application_no", "publication_no", "grant_no", "patent_type", "ipc_all_raw", "ipc_main_raw"]
_DATES = ["application_date", "publication_date", "grant_date"]

REC = f"""rec AS (SELECT rec_id AS ord, {', '.join(f"trim(coalesce({c}, '')) AS {c}" for c in _PLAIN)}, {', '.join(f'{date(c)} AS {c}' for c in _DATES)}, {STOCK.format(c='stkcd_raw')} AS stkcd,
 CASE WHEN trim(coalesce(patent_type, '')) IN ('发明申请', '发明授权', '发明公布') THEN 'invention' WHEN trim(coalesce(patent_type, '')) = '实用新型' THEN 'utility_model' WHEN trim(coalesce(patent_type, '')) = '外观设计' THEN 'design' ELSE 'other' END AS patent_type_group FROM raw_records)"""

CORE = f"""{REC}, {tokens('atk', 'rec', 'ord', 'ipc_all_raw', 'application_no')}, {tokens('mt', 'rec', 'ord', 'ipc_main_raw', 'application_no')},
subs AS (SELECT ord, application_no, array_to_string(list_sort(list_distinct(list(sub))), '|') AS s FROM atk GROUP BY ALL),
conf AS (SELECT rec.application_no, count(DISTINCT coalesce(s, '')) AS k FROM rec LEFT JOIN subs ON rec.ord = subs.ord WHERE rec.application_no <> '' GROUP BY 1),
allsub AS (SELECT application_no, array_to_string(list_sort(list_distinct(list(sub))), '|') AS s FROM atk GROUP BY 1),
mains AS (SELECT application_no, min(sub) AS m FROM mt GROUP BY 1),
grp AS (SELECT application_no, {', '.join(f'CASE WHEN min({c}) = max({c}) THEN min({c}) END AS {c}' for c in _DATES)}, min(nullif(publication_no, '')) AS publication_no, min(nullif(grant_no, '')) AS grant_no,
 {joined('patent_type')} AS patent_type, CASE WHEN bool_or(patent_type_group = 'invention') THEN 'invention' ELSE arg_min(patent_type_group, ord) END AS patent_type_group, {joined('ipc_all_raw')} AS raw_ipc_values,
 count(*) AS source_record_count, {', '.join(f'coalesce(min({c}) <> max({c}), false)::int AS {c}_conflict' for c in _DATES)},
 (count(DISTINCT nullif(publication_no, '')) > 1 OR count(DISTINCT nullif(grant_no, '')) > 1 OR count(DISTINCT nullif(patent_type, '')) > 1)::int AS metadata_conflict_flag FROM rec WHERE application_no <> '' GROUP BY 1),
core AS (SELECT grp.*, coalesce(allsub.s, '') AS ipc_subclasses, m AS ipc_main_subclass, (k > 1)::int AS ipc_conflict_flag FROM grp LEFT JOIN allsub USING (application_no) LEFT JOIN mains USING (application_no) JOIN conf USING (application_no))"""

EDGES = f"""edge AS (SELECT stkcd, application_no, stkcd AS listed_parent, arg_min(stkcd_raw, ord) AS stkcd_raw, arg_min(company_name, ord) AS company_name, {joined('relation')} AS relation,
 {joined('relation')} AS relation_type, max((relation IN ('上市公司本身', '上市公司的子公司'))::int) AS baseline_eligible, arg_min(applicant, ord) AS applicant, arg_min(applicant_type, ord) AS applicant_type
 FROM rec WHERE application_no <> '' AND stkcd IS NOT NULL GROUP BY stkcd, application_no)"""

UNIVERSE = f"""{CORE}, {EDGES}, fc AS (SELECT application_no, sum(baseline_eligible) AS eligible_firm_count, count(*) AS all_firm_count FROM edge GROUP BY 1),
counted AS (SELECT core.*, coalesce(eligible_firm_count, 0)::bigint AS eligible_firm_count, coalesce(all_firm_count, 0)::bigint AS all_firm_count FROM core LEFT JOIN fc USING (application_no)),
universe AS (SELECT * FROM counted WHERE eligible_firm_count > 0 AND patent_type_group IN ('invention', 'utility_model') AND application_date IS NOT NULL AND application_date_conflict = 0)"""

CODE_EDGES = f"""{UNIVERSE}, {tokens('ut', 'universe', 'application_no', 'raw_ipc_values', 'application_date, ipc_main_subclass')},
tax AS (SELECT ipc_code, max(scheme_version) AS v FROM ipc_dictionary WHERE is_valid AND ipc_level = 'subclass' AND scheme_version IN ('2026.01', '2025.01') GROUP BY 1),
mapped AS (SELECT ut.*, v AS taxonomy_version, CASE v WHEN '2026.01' THEN 'current_subclass' WHEN '2025.01' THEN 'historical_bridge_subclass' ELSE 'unmatched' END AS mapping_status FROM ut LEFT JOIN tax ON ut.sub = tax.ipc_code),
ce AS (SELECT application_no, application_date, {quarter('application_date')} AS quarter, sub AS ipc_subclass, 1.0::double / count(*) OVER (PARTITION BY application_no) AS fractional_weight,
 coalesce(sub = any_value(ipc_main_subclass), false)::int AS is_main_ipc, any_value(mapping_status) AS mapping_status, any_value(taxonomy_version) AS taxonomy_version, arg_min(raw, pos) AS raw_ipc
 FROM mapped WHERE mapping_status <> 'unmatched' GROUP BY application_no, application_date, sub)"""

def ordered_sum(items: str) -> str:
    """Sum of a list from the left: list_sum may add in another order."""
    return f"list_reduce(list_concat([0.0::double], {items}), lambda a, x: a + x)"


MASS = f"""{CODE_EDGES}, wn AS (SELECT quarter, ipc_subclass, fractional_weight AS w, count(*) AS n FROM ce GROUP BY ALL),
mass AS (SELECT quarter, ipc_subclass, {ordered_sum('list(w * n ORDER BY w)')} AS mass FROM wn GROUP BY ALL)"""

_DIVERSITY = f"""SELECT {{q}}, count(*) AS unique_ipc_subclass_count, {ordered_sum('list(-p * ln(p) ORDER BY ipc_subclass)')} AS ipc_entropy, {ordered_sum('list(p * p ORDER BY ipc_subclass)')} AS ipc_hhi,
 1 - {ordered_sum('list(p * p ORDER BY ipc_subclass)')} AS ipc_one_minus_hhi, {ordered_sum('list(-p * ln(w) ORDER BY ipc_subclass)')} AS related_variety, {ordered_sum('list(-p * ln(b) ORDER BY ipc_subclass)')} AS unrelated_variety
 FROM (SELECT {{q}}, ipc_subclass, m / t AS p, m / g AS w, g / t AS b FROM (SELECT {{q}}, t, c.g AS g, unnest(c.codes, recursive := true) FROM
 (SELECT {{q}}, {ordered_sum('list(g ORDER BY k)')} AS t, unnest(list({{{{'g': g, 'codes': codes}}}})) AS c FROM
 (SELECT {{q}}, left(ipc_subclass, 3) AS k, {ordered_sum('list(mass ORDER BY ipc_subclass)')} AS g, list({{{{'ipc_subclass': ipc_subclass, 'm': mass}}}}) AS codes FROM {{src}} GROUP BY ALL) GROUP BY {{q}}))) GROUP BY 1"""


def diversity(q: str = "quarter", src: str = "mass") -> str:
    return _DIVERSITY.format(q=q, src=src)


PAIRS = f"""{MASS}, prs AS (SELECT x.application_no, x.application_date, x.ipc_subclass AS ipc_a, y.ipc_subclass AS ipc_b FROM ce x JOIN ce y ON x.application_no = y.application_no AND x.ipc_subclass < y.ipc_subclass),
pd AS (SELECT ipc_a, ipc_b, application_date, count(*) AS n FROM prs GROUP BY ALL), cd AS (SELECT ipc_subclass, application_date, count(*) AS n FROM ce GROUP BY ALL), dd AS (SELECT application_date, sum(n) AS n FROM pd GROUP BY 1),
hp AS (SELECT ipc_a, ipc_b, application_date, coalesce(sum(n) OVER (PARTITION BY ipc_a, ipc_b ORDER BY application_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h FROM pd),
hc AS (SELECT ipc_subclass, application_date, coalesce(sum(n) OVER (PARTITION BY ipc_subclass ORDER BY application_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h FROM cd),
ht AS (SELECT application_date, coalesce(sum(n) OVER (ORDER BY application_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h FROM dd),
ev0 AS (SELECT prs.*, hp.h AS historical_pair_count, ht.h AS historical_total_pair_count, (hp.h + 1.0::double) / (ht.h + 214185.0::double) AS pr,
 greatest(0.0::double, least(1.0::double, 1.0::double - CASE WHEN a.h > 0 AND b.h > 0 THEN hp.h / sqrt(a.h::double * b.h::double) ELSE 0.0::double END)) AS dist
 FROM prs JOIN hp USING (ipc_a, ipc_b, application_date) JOIN ht USING (application_date) JOIN hc a ON a.ipc_subclass = prs.ipc_a AND a.application_date = prs.application_date
 JOIN hc b ON b.ipc_subclass = prs.ipc_b AND b.application_date = prs.application_date),
ev AS (SELECT application_no, application_date, {quarter('application_date')} AS quarter, ipc_a, ipc_b, ipc_a || '|' || ipc_b AS pair_id, historical_pair_count::bigint AS historical_pair_count, historical_total_pair_count::bigint AS historical_total_pair_count,
 (historical_pair_count = 0)::int AS historical_first, pr AS smoothed_pair_probability, -ln(pr) AS pair_rarity, 1 - dist AS technological_relatedness, dist AS technological_distance FROM ev0)"""

RAO = f"""rq AS (SELECT DISTINCT {qord('application_date')} AS q FROM ce), rm AS (SELECT left(quarter, 4)::int * 4 + right(quarter, 1)::int - 1 AS q, ipc_subclass, mass AS m FROM mass),
rp AS (SELECT q, ipc_subclass, m / sum(m) OVER (PARTITION BY q) AS p FROM rm), rn AS (SELECT rq.q, ipc_subclass, count(*) AS n FROM ce JOIN rq ON {qord('application_date')} < rq.q GROUP BY ALL),
rpn AS (SELECT rq.q, ipc_a, ipc_b, count(*) AS n FROM prs JOIN rq ON {qord('application_date')} < rq.q GROUP BY ALL),
rx AS (SELECT rpn.q, sum(2 * a.p * b.p * (1 - greatest(0.0, least(1.0, 1 - rpn.n / sqrt(na.n::double * nb.n::double))))) AS r FROM rpn JOIN rp a ON a.q = rpn.q AND a.ipc_subclass = rpn.ipc_a JOIN rp b ON b.q = rpn.q AND b.ipc_subclass = rpn.ipc_b
 JOIN rn na ON na.q = rpn.q AND na.ipc_subclass = rpn.ipc_a JOIN rn nb ON nb.q = rpn.q AND nb.ipc_subclass = rpn.ipc_b GROUP BY 1),
rh AS ({diversity()}), rao AS (SELECT rh.quarter, greatest(0.0, 1 - ipc_hhi - coalesce(r, 0)) AS rao_stirling_diversity FROM rh LEFT JOIN rx ON {qlabel('rx.q')} = rh.quarter)"""

KINDS = f"""kinds AS (SELECT {quarter('application_date')} AS quarter, {', '.join(f"count(*) FILTER (patent_type_group = '{k}') AS {k}_count" for k in ('invention', 'utility_model', 'design', 'other'))}, count(*) AS eligible_all_count
 FROM counted WHERE eligible_firm_count > 0 AND application_date IS NOT NULL GROUP BY 1)"""

_ZEROS = ["patent_count", "invention_patent_count", "utility_model_patent_count", "design_patent_count", "other_patent_count", "eligible_all_patent_count", "ipc_coded_patent_count",
          "unique_ipc_subclass_count", "single_ipc_patent_count", "multi_ipc_patent_count", "novel_patent_count", "all_ipc_pair_count", "novel_ipc_pair_count"]

METRICS = f"""{PAIRS}, {RAO}, {KINDS}, sc AS (SELECT application_no, count(*) AS k FROM ce GROUP BY 1),
m1 AS (SELECT {quarter('application_date')} AS quarter, count(*) AS patent_count, count(*) FILTER (patent_type_group = 'invention') AS invention_patent_count, count(*) FILTER (patent_type_group = 'utility_model') AS utility_model_patent_count,
 count(k) AS ipc_coded_patent_count, avg(k) AS average_patent_scope, median(k) AS median_patent_scope, count(*) FILTER (k = 1) AS single_ipc_patent_count, count(*) FILTER (k > 1) AS multi_ipc_patent_count
 FROM universe LEFT JOIN sc USING (application_no) GROUP BY 1),
pa AS (SELECT quarter, application_no, max(historical_first) AS novel, count(*) AS n, sum(historical_first) AS nn, avg(pair_rarity) AS rarity, sum(pair_rarity) AS rs, avg(technological_distance) AS dist FROM ev GROUP BY ALL),
m2 AS (SELECT quarter, sum(novel) AS novel_patent_count, sum(n) AS all_ipc_pair_count, sum(nn) AS novel_ipc_pair_count, avg(rarity) AS pair_rarity_mean, sum(rs) / sum(n) AS pair_rarity_pair_weighted_mean,
 avg(dist) AS average_technological_distance, median(dist) AS median_technological_distance FROM pa GROUP BY 1),
m3 AS ({diversity()}), mk AS (SELECT quarter, design_count AS design_patent_count, other_count AS other_patent_count, eligible_all_count AS eligible_all_patent_count FROM kinds),
lastq AS (SELECT max(quarter) AS z FROM (SELECT quarter FROM m1 UNION ALL SELECT quarter FROM mk)),
cal AS (SELECT {qlabel('o')} AS quarter FROM (SELECT unnest(range(1985 * 4, left(z, 4)::int * 4 + right(z, 1)::int)) AS o FROM lastq)),
mm AS (SELECT quarter, {', '.join(f'coalesce({c}, 0)::bigint AS {c}' for c in _ZEROS)}, average_patent_scope, median_patent_scope, pair_rarity_mean, pair_rarity_pair_weighted_mean, average_technological_distance, median_technological_distance,
 ipc_entropy, ipc_hhi, ipc_one_minus_hhi, related_variety, unrelated_variety, rao_stirling_diversity FROM cal LEFT JOIN m1 USING (quarter) LEFT JOIN mk USING (quarter) LEFT JOIN m3 USING (quarter) LEFT JOIN rao USING (quarter) LEFT JOIN m2 USING (quarter)),
metrics AS (SELECT *, design_patent_count / nullif(eligible_all_patent_count, 0)::double AS design_patent_share, ipc_coded_patent_count / nullif(patent_count, 0)::double AS ipc_coding_rate,
 greatest(0, patent_count - ipc_coded_patent_count)::bigint AS ipc_missing_patent_count, greatest(0, patent_count - ipc_coded_patent_count) / nullif(patent_count, 0)::double AS ipc_missing_rate,
 multi_ipc_patent_count / nullif(ipc_coded_patent_count, 0)::double AS multi_ipc_patent_share, novel_patent_count / nullif(multi_ipc_patent_count, 0)::double AS novel_patent_share,
 novel_ipc_pair_count / nullif(all_ipc_pair_count, 0)::double AS novel_pair_share, '1985-01-01' AS history_start_date, (left(quarter, 4)::int <= 1993)::int AS pre_sample_initialization_flag FROM mm)"""

def mapped_characters(name: str, source: str, key: str, text: str, mapping: dict[str, str]) -> str:
    """CTE ``name`` (``id``, ``v``): a text with characters replaced by a table and composed; null and empty texts have no row."""
    rows = ", ".join(f"({ord(k)}, " + "'" + v.replace("'", "''") + "')" for k, v in sorted(mapping.items()))
    cut = f"regexp_extract_all({text}, '(?s).')"
    return f"""{name}_m(u, t) AS (VALUES {rows}), {name}_c AS (SELECT {key} AS id, unnest({cut}) AS c, generate_subscripts({cut}, 1) AS pos FROM {source} WHERE {text} <> ''),
{name} AS (SELECT id, nfc_normalize(string_agg(coalesce(t, c), '' ORDER BY pos)) AS v FROM {name}_c LEFT JOIN {name}_m ON unicode(c) = u GROUP BY id)"""


def compatibility_forms() -> dict[str, str]:
    """Every character whose compatibility form is another, by rule of the standard."""
    import unicodedata

    forms = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0x80, 0x30000) if not 0xAC00 <= c < 0xE000}
    return {k: v for k, v in forms.items() if k != v}


_META = ["stkcd_raw", "stkcd", "company_name", "relation", "relation_type", "listed_parent", "applicant", "applicant_type"]

TEXT = f"""tr AS (SELECT text_id AS ord, trim(application_no) AS application_no, {', '.join(_META)}, {date('application_date')} AS application_date, patent_type_group, coalesce(baseline_eligible, 0) AS baseline_eligible,
 coalesce(claim_present_flag, 0) AS claim_present_flag, coalesce(claim_length_chars, 0) AS claim_length_chars, coalesce(abstract_clean, '') AS abstract_clean FROM text_records WHERE trim(application_no) <> ''),
tb AS (SELECT application_no, arg_max(ord, (length(abstract_clean) * 1000000000000 - ord)) AS best, min(ord) FILTER (baseline_eligible = 1) AS rep, min(application_date) AS application_date,
 coalesce(min(application_date) <> max(application_date), false)::int AS application_date_conflict, bool_or(baseline_eligible = 1) AS any_eligible, count(DISTINCT nullif(abstract_clean, '')) AS abstract_version_count,
 count(*) AS abstract_source_record_count, {joined('relation_type', ' | ')} AS relation_type_values, {joined('listed_parent', ' | ')} AS listed_parent_values, {joined('applicant', ' | ')} AS applicant_values,
 max(claim_present_flag) AS claim_present_flag, max(claim_length_chars) AS claim_length_chars FROM tr GROUP BY 1),
tc AS (SELECT tb.application_no, tb.application_date, {quarter('tb.application_date')} AS quarter, b.patent_type_group, {', '.join(f'coalesce(r.{c}, b.{c}) AS {c}' for c in _META)}, b.abstract_clean, length(b.abstract_clean) AS abstract_length_chars,
 CASE WHEN b.abstract_clean = '' THEN 0 ELSE len(list_distinct(regexp_extract_all(b.abstract_clean, '(?s).'))) END AS abstract_unique_char_count, abstract_source_record_count, abstract_version_count, (abstract_version_count > 1)::int AS abstract_conflict_flag,
 relation_type_values, listed_parent_values, applicant_values, (any_eligible AND application_date_conflict = 0)::int AS baseline_eligible, tb.claim_present_flag, tb.claim_length_chars, application_date_conflict
 FROM tb JOIN tr b ON b.ord = tb.best LEFT JOIN tr r ON r.ord = tb.rep)"""
