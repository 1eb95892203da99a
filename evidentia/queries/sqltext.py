"""SQL shared by several oracles (DuckDB)."""

from __future__ import annotations

import unicodedata

# What the oracles hold the engine against is stated here anew; nothing comes from the code under test.
_PAIRS = [(chr(c), unicodedata.decomposition(chr(c)).split()) for c in range(0xC0, 0x250) if chr(c).lower() == chr(c)]
_PAIRS = [(c, chr(int(d[0], 16))) for c, d in _PAIRS if len(d) == 2 and not d[0].startswith("<") and int(d[0], 16) < 128]
#: Lower-case letters that are a plain letter with one mark, and the plain letters.
MARKED, PLAIN = "".join(c for c, _ in _PAIRS), "".join(d for _, d in _PAIRS)
#: A text with one of these ends, in any case, or with a single capital and a full stop, doesn't end a sentence.
ABBREVIATION = r"(e\.g\.|i\.e\.|et al\.|fig\.|figs\.|eq\.|eqs\.|sec\.|secs\.|sect\.|sects\.|ref\.|refs\.|no\.|nos\.|dr\.|prof\.|vs\.|cf\.|approx\.)$"
INITIAL = r"(^|\W)[A-Z]\.$"
_NUMBERS = r"\d+(?:\s*[,;\-‐‑‒–—−]\s*\d+)*"
#: Without look-ahead the capital is consumed, so where it is all of a sentence the next cut needs a second pass.
_CITED = rf"([A-Za-z)\]][.!?](?:\[\s*{_NUMBERS}\s*\]|\(\s*{_NUMBERS}\s*\)|{_NUMBERS}))\s+([A-Z])"
CITED = lambda x: f"regexp_replace(regexp_replace({x}, '{_CITED}', '\\1' || chr(31) || '\\2', 'g'), '{_CITED}', '\\1' || chr(31) || '\\2', 'g')"

TRIM = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
TERMS = lambda x: rf"regexp_extract_all(translate(lower(coalesce({x}, '')), '{MARKED}', '{PLAIN}'), '[\p{{L}}\p{{N}}]+')"
WORDS = lambda x: rf"len(regexp_extract_all({x}, '\S+'))"

CLAIMS = "claims AS (SELECT item_id AS claim_id, text AS claim FROM benchmark)"
#: claim_id, term, times, as lexical.claim_terms.
CLAIM_TERMS = rf"""{CLAIMS},
qt0 AS (SELECT claim_id, unnest(regexp_extract_all(replace(lower(claim), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+')) AS w FROM claims),
qt AS (SELECT claim_id, translate(w, '{MARKED}', '{PLAIN}') AS term, count(*) AS times FROM (SELECT DISTINCT claim_id, w FROM qt0) GROUP BY ALL)"""
INDEX = f"""tk AS (SELECT doc_id AS passage_id, {TERMS('text')} AS t FROM documents),
po AS (SELECT passage_id, len(t) AS dl, unnest(t) AS term FROM tk),
post AS (SELECT term, passage_id, count(*) AS tf, any_value(dl) AS dl FROM po GROUP BY term, passage_id),
ts AS (SELECT term, count(*) AS df FROM post GROUP BY term),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tk)"""
BM25 = """bm AS (SELECT claim_id, passage_id, round(sum(-(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 0.000001 ELSE ln((n - df + 0.5) / (df + 0.5)) END
  * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) * times), 6) AS bm25_score FROM qt JOIN ts USING (term) JOIN post USING (term) CROSS JOIN st GROUP BY claim_id, passage_id),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY bm25_score, passage_id) AS bm25_rank FROM bm) WHERE bm25_rank <= 100)"""


def vectors(name: str, source: str, id_: str, text: str) -> str:
    return f"""{name}0 AS (SELECT id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS place, count(*)::DOUBLE AS n FROM (SELECT {id_} AS id, unnest({TERMS(text)}) AS t FROM {source}) GROUP BY ALL),
{name} AS (SELECT id, place, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS v FROM {name}0)"""


DENSE = f"""{vectors('dv', 'documents', 'doc_id', 'text')},
{vectors('cv', 'claims', 'claim_id', 'claim')},
ids AS (SELECT DISTINCT id FROM dv), cids AS (SELECT DISTINCT id FROM cv),
sc AS (SELECT cv.id AS claim_id, dv.id AS passage_id, sum(cv.v * dv.v) AS s FROM cv JOIN dv USING (place) GROUP BY ALL),
ds AS (SELECT cids.id AS claim_id, ids.id AS passage_id, round(coalesce(s, 0), 6) AS dense_score FROM cids CROSS JOIN ids LEFT JOIN sc ON sc.claim_id = cids.id AND sc.passage_id = ids.id),
den AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY dense_score DESC, passage_id) AS dense_rank FROM ds) WHERE dense_rank <= 100)"""
FUSED = """fu AS (SELECT claim_id, passage_id, dense_rank, dense_score, bm25_rank, bm25_score,
  round(coalesce(2.0 / (60.0 + dense_rank), 0.0) + coalesce(1.0 / (60.0 + bm25_rank), 0.0), 9) AS fusion_score FROM den FULL OUTER JOIN lex USING (claim_id, passage_id)),
fused AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY fusion_score DESC, dense_rank ASC NULLS LAST, bm25_rank ASC NULLS LAST, passage_id) AS fusion_rank FROM fu)"""
HYBRID = f"WITH {CLAIM_TERMS}, {INDEX}, {BM25}, {DENSE}, {FUSED}"


def sentences(source: str = "documents") -> str:
    """CTEs up to sen: document_id, page_index, logical_block_index, block_sentence_index, page_sentence_index, source_text."""
    return rf"""ln0 AS (SELECT doc_id AS document_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS lb FROM {source}),
ln AS (SELECT document_id, lb, {TRIM('line')} AS block FROM ln0),
pa0 AS (SELECT document_id, lb, string_split(regexp_replace(block, '([.!?…]["”’)\]]*)\s+', '\1' || chr(31), 'g'), chr(31)) AS p FROM ln),
pa1 AS (SELECT document_id, lb, unnest(p) AS part, generate_subscripts(p, 1) AS i FROM pa0),
pa AS (SELECT * FROM pa1 WHERE {TRIM('part')} <> ''),
fl AS (SELECT *, regexp_matches(lower(regexp_replace(part, '\s+$', '')), '{ABBREVIATION}') OR regexp_matches(regexp_replace(part, '\s+$', ''), '{INITIAL}') AS abb FROM pa),
gr AS (SELECT *, sum(CASE WHEN prev THEN 0 ELSE 1 END) OVER (PARTITION BY document_id, lb ORDER BY i) AS g FROM (SELECT *, coalesce(lag(abb) OVER (PARTITION BY document_id, lb ORDER BY i), false) AS prev FROM fl)),
me AS (SELECT document_id, lb, g, string_agg(part, ' ' ORDER BY i) AS m FROM gr GROUP BY ALL),
cu0 AS (SELECT document_id, lb, g, string_split({CITED('m')}, chr(31)) AS c FROM me),
cu AS (SELECT document_id, lb, g, {TRIM('unnest(c)')} AS source_text, generate_subscripts(c, 1) AS k FROM cu0),
sen AS MATERIALIZED (SELECT document_id, 0 AS page_index, lb AS logical_block_index, row_number() OVER (PARTITION BY document_id, lb ORDER BY g, k) - 1 AS block_sentence_index,
  row_number() OVER (PARTITION BY document_id ORDER BY lb, g, k) - 1 AS page_sentence_index, source_text FROM cu WHERE source_text <> '')"""


PASSAGES = f"""WITH RECURSIVE {sentences()},
wc AS (SELECT *, {WORDS('source_text')} AS n FROM sen),
cs AS (SELECT *, sum(n) OVER (PARTITION BY document_id, logical_block_index ORDER BY block_sentence_index) AS upto FROM wc),
en0 AS (SELECT a.document_id, a.logical_block_index AS lb, a.block_sentence_index AS s, count(*) AS len, count(*) FILTER (WHERE b.upto <= a.upto - a.n + 180) AS reach
  FROM cs a JOIN cs b ON a.document_id = b.document_id AND a.logical_block_index = b.logical_block_index GROUP BY a.document_id, a.logical_block_index, a.block_sentence_index),
en AS MATERIALIZED (SELECT document_id, lb, s, len, greatest(s + 1, reach) AS e FROM en0),
ps AS (SELECT document_id, lb, 0::BIGINT AS idx, s, e, len FROM en WHERE s = 0
  UNION ALL SELECT en.document_id, en.lb, ps.idx + 1, en.s, en.e, en.len FROM ps JOIN en ON en.document_id = ps.document_id AND en.lb = ps.lb AND en.s = greatest(ps.s + 1, ps.e - 1) WHERE ps.e < ps.len),
pas AS (SELECT ps.document_id, ps.lb AS logical_block_index, ps.idx AS block_passage_index, ps.s, ps.e, string_agg(sen.source_text, ' ' ORDER BY sen.block_sentence_index) AS source_text, count(*) AS sentence_count
  FROM ps JOIN sen ON sen.document_id = ps.document_id AND sen.logical_block_index = ps.lb AND sen.block_sentence_index >= ps.s AND sen.block_sentence_index < ps.e GROUP BY ALL),
passages AS (SELECT printf('%s:p%04d:lb%04d:c%03d', document_id::VARCHAR, 1, logical_block_index, block_passage_index) AS display_id, *, {WORDS('source_text')} AS word_count FROM pas)"""
