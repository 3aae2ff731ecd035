"""SQL building blocks for the DuckDB oracle.

The oracle is written independently of the Spark plans: dense textbook
formulas where the Spark side uses sparse or salted forms, so agreement
checks the algebra as well as the code.
"""

from __future__ import annotations

from ..functions.stopwords import token_stop_words
from ..options import NB_ALPHA, NB_CONFIDENCE_THRESHOLD, FALLBACK_CATEGORY

TOKEN_RE_SQL = r"[\p{L}\p{N}_]{2,}"
WORD_RE_SQL = r"[^\s\p{Z}]+"
NON_SPACE_RE_SQL = r"[^\s\p{Z}]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def stop_list_sql() -> str:
    return "[" + ", ".join(q(w) for w in token_stop_words()) + "]"


def file_path_sql(alias: str = "") -> str:
    p = f"{alias}." if alias else ""
    return f"({p}source || '/' || CAST({p}doc_id AS VARCHAR) || '.txt')"


def words_sql(text: str) -> str:
    return f"regexp_extract_all({text}, '{WORD_RE_SQL}')"


def blank_sql(text: str) -> str:
    return f"({text} IS NULL OR NOT regexp_matches({text}, '{NON_SPACE_RE_SQL}'))"


def term_counts_ctes(prefix: str, source: str, id_col: str, keep: list[str], bigrams: bool = True) -> str:
    """CTEs ``{prefix}_tok`` and ``{prefix}_tf(id, *keep, term, tf)`` over ``source``."""
    k = "".join(f", {c}" for c in keep)
    grams = f"SELECT {id_col}{k}, unnest(t) AS term FROM {prefix}_tok"
    if bigrams:
        grams += (f"\n  UNION ALL SELECT {id_col}{k}, unnest(list_transform(range(1, len(t)), "
                  f"lambda i: t[i] || ' ' || t[i + 1])) AS term FROM {prefix}_tok")
    return f"""{prefix}_tok AS (
  SELECT {id_col}{k}, list_filter(regexp_extract_all(lower(text), '{TOKEN_RE_SQL}'),
         lambda x: NOT list_contains({stop_list_sql()}, x)) AS t
  FROM {source}),
{prefix}_grams AS (
  {grams}),
{prefix}_tf AS (
  SELECT {id_col}{k}, term, count(*) AS tf FROM {prefix}_grams GROUP BY ALL)"""


def nb_model_ctes(train: str, alpha: float = NB_ALPHA, bigrams: bool = True) -> str:
    """CTEs fitting TF-IDF + multinomial NB on ``train(sample_id, text, label, weight)``.

    Produces ``vocab(term, idf)``, ``logp(label, term, lp)`` (dense) and
    ``prior(label, lprior)``.
    """
    return f"""{term_counts_ctes('tr', train, 'sample_id', ['label', 'weight'], bigrams)},
tot AS (SELECT CAST(sum(weight) AS DOUBLE) AS n FROM {train}),
vocab AS (
  SELECT term, ln((1 + any_value(tot.n)) / (1 + sum(weight))) + 1 AS idf FROM tr_tf, tot GROUP BY term),
nv AS (SELECT CAST(count(*) AS DOUBLE) AS v FROM vocab),
tw AS (SELECT tr_tf.*, (1 + ln(tf)) * vocab.idf AS xr FROM tr_tf JOIN vocab USING (term)),
tnorm AS (SELECT sample_id, sqrt(sum(xr * xr)) AS norm FROM tw GROUP BY sample_id),
nct AS (SELECT label, term, sum(weight * xr / norm) AS n_ct FROM tw JOIN tnorm USING (sample_id) GROUP BY label, term),
cls AS (SELECT label, CAST(sum(weight) AS DOUBLE) AS n_c FROM {train} GROUP BY label),
cmass AS (SELECT label, sum(n_ct) AS mass FROM nct GROUP BY label),
logp AS (
  SELECT c.label, v.term,
         ln((coalesce(nct.n_ct, 0) + {alpha}) / (coalesce(cm.mass, 0) + {alpha} * nv.v)) AS lp
  FROM cls c CROSS JOIN vocab v CROSS JOIN nv
  LEFT JOIN nct ON nct.label = c.label AND nct.term = v.term
  LEFT JOIN cmass cm ON cm.label = c.label),
prior AS (SELECT label, ln(n_c / tot.n) AS lprior FROM cls, tot)"""


def nb_score_ctes(docs: str, id_col: str = "doc_id", bigrams: bool = True,
                  threshold: float = NB_CONFIDENCE_THRESHOLD, fallback: str = FALLBACK_CATEGORY) -> str:
    """CTEs scoring ``docs(id, text)`` with the model CTEs; result CTE ``nb_result``.

    ``nb_result(id, category, confidence_pct, is_low)``.
    """
    return f"""{term_counts_ctes('sc', docs, id_col, [], bigrams)},
sw AS (SELECT {id_col}, term, (1 + ln(tf)) * idf AS xr FROM sc_tf JOIN vocab USING (term)),
snorm AS (SELECT {id_col}, sqrt(sum(xr * xr)) AS norm FROM sw GROUP BY {id_col}),
sterm AS (
  SELECT sw.{id_col}, logp.label, sum(sw.xr / snorm.norm * logp.lp) AS s
  FROM sw JOIN snorm USING ({id_col}) JOIN logp USING (term) GROUP BY sw.{id_col}, logp.label),
jll AS (
  SELECT d.{id_col}, p.label, p.lprior + coalesce(st.s, 0) AS jll
  FROM {docs} d CROSS JOIN prior p
  LEFT JOIN sterm st ON st.{id_col} = d.{id_col} AND st.label = p.label),
jmax AS (SELECT {id_col}, max(jll) AS m FROM jll GROUP BY {id_col}),
best AS (
  SELECT {id_col}, min(label) FILTER (WHERE jll = m) AS label, 1.0 / sum(exp(jll - m)) AS conf
  FROM jll JOIN jmax USING ({id_col}) GROUP BY {id_col}),
nb_result AS (
  SELECT d.{id_col},
         CASE WHEN {blank_sql('d.text')} OR b.conf < {threshold} THEN {q(fallback)} ELSE b.label END AS category,
         CASE WHEN {blank_sql('d.text')} THEN 0.0 ELSE round(b.conf * 100, 1) END AS confidence_pct,
         ({blank_sql('d.text')} OR b.conf < {threshold}) AS is_low
  FROM {docs} d JOIN best b USING ({id_col}))"""


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def suffix_sql(n: str) -> str:
    return rf"regexp_extract({n}, '(?s)^.+(\.[^.]+)$', 1)"


def stem_sql(n: str) -> str:
    return f"left({n}, length({n}) - length({suffix_sql(n)}))"


def sanitise_sql(raw: str) -> str:
    """Proposed name -> file stem, same steps as ``functions.text.sanitise_name``."""
    last = f"regexp_extract({raw}, '([^/]*)$', 1)"
    stemmed = f"(CASE WHEN contains({raw}, '.') THEN {stem_sql(last)} ELSE {raw} END)"
    first_line = strip_sql(f"split_part({stemmed}, chr(10), 1)")
    kept = rf"regexp_replace(replace({first_line}, ' ', '_'), '[^\p{{L}}\p{{N}}_\-]', '', 'g')"
    return f"substr(regexp_replace({kept}, '^_+|_+$', '', 'g'), 1, 80)"


def proposed_name_sql(original: str, text: str, raw: str) -> str:
    clean = sanitise_sql(raw)
    return (f"CASE WHEN length({strip_sql(text)}) >= 20 AND {raw} IS NOT NULL AND length({clean}) > 0 "
            f"THEN {clean} || {suffix_sql(original)} ELSE {original} END")
