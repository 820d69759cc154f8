"""DuckDB SQL that must give the same rows as the core queries, over the same whole tables.

Left without SQL, and tested against brute force instead: the chunker (a sequential fold) and word error rates. DuckDB's edit distance counts bytes, so for the character measures the
different characters of a pair of texts are first mapped to single bytes.
"""

from pagemill.operators.chunking import CLOSERS, OPENERS, TERMINATORS
from pagemill.operators.stages import STAGES

#: White space as Python's str.isspace sees it, for RE2.
_WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NWS = "[^" + _WS[1:]
_BN = r"[\x{0980}-\x{09FF}]"
_DEP = r"[\x{09BC}\x{09BE}-\x{09C4}\x{09C7}\x{09C8}\x{09CB}\x{09CC}\x{09CD}\x{09D7}]"
_ORPHAN = r"[\x{09BE}-\x{09CC}\x{09CD}]"
_TRIPLE = "|".join(chr(c) * 3 for c in range(0x985, 0x9BA))

_P = "p AS (SELECT * FROM document_pages QUALIFY row_number() OVER (PARTITION BY document_id, page_no ORDER BY updated_at DESC NULLS LAST) = 1)"
_C = "c AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST) = 1)"
_E = "e AS (SELECT * FROM document_embeddings QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC NULLS LAST) = 1)"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def _tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_WS}+'), lambda w: regexp_matches(w, '{_BN}'))"


def _ortho(x: str, source: str, keep: str = "document_id, page_no") -> str:
    """CTEs o0 and o: the orthography columns of ``x`` for the rows of ``source``."""
    return f"""
o0 AS (SELECT {keep}, {x} AS t, {_tokens(x)} AS tok FROM {source}),
o AS (
  SELECT {keep}, t, len(tok) AS tokens, list_filter(tok, lambda w: regexp_matches(w, '^{_DEP}')) AS bad,
         {_count('t', _TRIPLE)} AS triples, {_count('t', _WS + _ORPHAN)} AS orphaned,
         len(list_filter(tok, lambda w: regexp_matches(w, '^{_DEP}'))) / greatest(len(tok), 1) AS rate FROM o0)"""


_LATIN = r"list_filter(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Za-z]{{2,}}'))"
_FONTS = "CASE WHEN json_valid(quality) THEN json_extract(quality, '$.fonts_ok')::BOOLEAN END"
_CLAIM_TOKENS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}\x{{0980}}-\x{{09FF}}]{{2,}}')"

_GATE = f"""
n AS (SELECT document_id, page_no, nfc_normalize(raw_text) AS t FROM p WHERE raw_text IS NOT NULL), {_ortho('t', 'n')},
g AS (
  SELECT document_id, page_no, NOT (rate > 0.005 OR triples > 0) AS trustworthy,
         NOT (rate > 0.005 OR triples > 0) AND CASE WHEN len(lat) + tokens > 0 THEN len(lat) / (len(lat) + tokens) ELSE 0 END > 0.10 AS latin_suspect,
         CAST(length(t) AS INTEGER) AS chars
  FROM (SELECT *, {_LATIN.format('t')} AS lat FROM o))"""

_TRIAGE = f"""
{_ortho('raw_text', 'p', 'document_id, page_no, raw_text, quality')},
tr AS (
  SELECT document_id, page_no, raw_text,
         CASE WHEN length({_trim("coalesce(raw_text, '')")}) < 20 THEN 'empty'
              WHEN coalesce({_FONTS}, true) AND NOT (rate > 0.005 OR triples > 0) THEN 'textlayer' ELSE 'needs_ocr' END AS source FROM o)"""

_QUESTIONS = f"""
{_C},
sc AS (SELECT document_id AS question, id AS chunk_id, page_no, text, 1 / (1.0::DOUBLE + page_no + ordinal) AS gate_score FROM c WHERE text IS NOT NULL),
sp AS (SELECT *, 'S' || n AS span_id FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY gate_score DESC, chunk_id) AS n FROM sc) WHERE n <= 5),
dq AS (SELECT id AS question, filename, ('0x' || substring(sha256, 1, 2))::INTEGER AS byte FROM documents),
gv AS (SELECT question, list({{'span_id': span_id, 'quote': text}} ORDER BY span_id) AS s FROM sp GROUP BY question),
cl AS (
  SELECT question, byte, CASE
    WHEN byte < 64 THEN []
    WHEN byte < 96 THEN [{{'span_id': 'S99', 'quote': s[1].quote}}]
    WHEN byte < 128 THEN [{{'span_id': s[1].span_id, 'quote': filename}}]
    WHEN byte < 160 THEN [{{'span_id': s[1].span_id, 'quote': s[1].quote}}, {{'span_id': s[1].span_id, 'quote': filename}}]
    ELSE s END AS claims FROM dq JOIN gv USING (question)),
k0 AS (SELECT question, unnest(claims) AS x, generate_subscripts(claims, 1) - 1 AS pos FROM cl),
k AS (
  SELECT question, pos, x.span_id AS span_id, sp.chunk_id, ov, bround3, sp.chunk_id IS NOT NULL AND ov >= 0.6 AS grounded
  FROM (SELECT k0.*, 0 AS z FROM k0) k0 LEFT JOIN sp ON sp.question = k0.question AND sp.span_id = k0.x.span_id,
  LATERAL (SELECT {_CLAIM_TOKENS.format("coalesce(k0.x.quote, '')")} AS ct, {_CLAIM_TOKENS.format("coalesce(sp.text, '')")} AS st) l,
  LATERAL (SELECT CASE WHEN len(ct) > 0 THEN len(list_filter(ct, lambda w: list_contains(st, w))) / len(ct) ELSE 0 END AS ov) m,
  LATERAL (SELECT round_even(ov, 3) AS bround3) r)"""
_QUESTIONS = _QUESTIONS.replace("SELECT question, pos, x.span_id", "SELECT k0.question, pos, k0.x.span_id")

_BEST = "gs AS (SELECT question, max(gate_score) AS best FROM sp GROUP BY question)"
_REASON = "CASE WHEN best IS NULL THEN 'nothing retrieved' WHEN best < 0.45 THEN 'best score ' || printf('%.4f', best) || ' is below the threshold 0.45' END"

_OUTCOME = f"""
{_QUESTIONS}, {_BEST},
ag AS (
  SELECT question, count(*) AS claims_total, count(*) FILTER (grounded) AS claims_grounded, count(*) FILTER (NOT grounded) AS ungrounded,
         list_sort(list(DISTINCT span_id) FILTER (chunk_id IS NULL)) AS unresolved FROM k GROUP BY question),
ans0 AS (
  SELECT dq.question, coalesce(claims_total, 0) AS claims_total, coalesce(claims_grounded, 0) AS claims_grounded, ungrounded,
         CASE WHEN {_REASON} IS NOT NULL THEN {_REASON}
              WHEN cl.question IS NULL OR cl.byte < 32 THEN 'model judged the spans insufficient'
              WHEN coalesce(claims_total, 0) = 0 THEN 'answer carried no cited claims'
              WHEN len(unresolved) > 0 THEN 'answer cited span id(s) that were not supplied: [' || array_to_string(list_transform(unresolved, lambda u: '''' || u || ''''), ', ') || '] - treating the answer as unfounded'
              WHEN claims_grounded = 0 THEN 'no claim''s quote could be found in the span it cited' END AS abstain_reason
  FROM dq LEFT JOIN gs USING (question) LEFT JOIN cl ON cl.question = dq.question LEFT JOIN ag ON ag.question = dq.question),
ans AS (
  SELECT question, abstain_reason IS NULL AS answered, claims_total, claims_grounded, abstain_reason,
         CASE WHEN abstain_reason IS NULL AND ungrounded > 0 THEN ungrounded || ' claim(s) could not be found in their span and were dropped' ELSE '' END AS warnings FROM ans0)"""

_STAGE_LIST = ", ".join(f"{{'pos': {i}, 'stage': '{s}'}}" for i, s in enumerate(STAGES, 1))
_RUNS = f"""
st AS (SELECT x.pos AS pos, x.stage AS stage FROM (SELECT unnest([{_STAGE_LIST}]) AS x)),
r0 AS (SELECT id AS document_id, stage, pos, ('0x' || substring(sha256, 2 * pos - 1, 2))::INTEGER AS b FROM documents, st WHERE sha256 IS NOT NULL),
r AS (
  SELECT document_id, stage, pos, CASE WHEN b < 150 THEN 'succeeded' WHEN b < 160 THEN 'skipped' WHEN b < 175 THEN 'failed' WHEN b < 185 THEN 'held'
         WHEN b < 205 THEN 'stale' WHEN b < 215 THEN 'running' ELSE 'pending' END AS status, CAST(b % 5 AS INTEGER) AS attempt FROM r0 WHERE b < 235),
f AS (
  SELECT document_id, stage, pos, status, attempt FROM r
  UNION ALL SELECT d.id, st.stage, st.pos, 'pending', 0 FROM documents d, st WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.document_id = d.id AND r.stage = st.stage)),
bl AS (
  SELECT document_id, stage, pos, status, attempt,
         coalesce(string_agg(CASE WHEN status NOT IN ('succeeded', 'skipped') THEN CASE WHEN status = 'held' THEN '`' || stage || '` is held for review' ELSE '`' || stage || '` is ' || status END END, ', ' ORDER BY pos)
           OVER (PARTITION BY document_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS blockers FROM f)"""
_RUNS = _RUNS.replace(", ' ORDER BY pos)\n           OVER", ", ')\n           OVER").replace("', ' ORDER BY pos)", "', ')")

_DOT = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_KNN = f"kn AS (SELECT a.vec_id AS q, b.vec_id AS p, b.label, {_DOT} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DOT} DESC, b.vec_id) <= {{k}})"
_CAND = f"""{_KNN.format(k=20)},
ca AS (SELECT q AS question, p AS chunk_id, CASE WHEN label % 5 = 0 THEN '' WHEN label % 2 = 0 THEN 'm-even' ELSE 'm-odd' END AS model,
       round(score, 6) AS score, CASE WHEN p % 2 = 0 THEN round(1 - round(score, 6), 6) END AS rerank_score FROM kn)"""

_GOLD = f"""{_P},
gp AS (SELECT p.document_id, p.page_no, p.raw_text, p.text FROM p WHERE raw_text IS NOT NULL AND EXISTS (SELECT 1 FROM gold_pages g WHERE g.gold_text IS NOT NULL AND g.document_id = p.document_id AND g.page_no = p.page_no)),
ou AS (
  SELECT document_id, page_no, 'scan' AS engine, raw_text AS text FROM gp UNION ALL SELECT document_id, page_no, 'normal', text FROM gp
  UNION ALL SELECT document_id, page_no, 'textlayer', regexp_replace(raw_text, '^[^\\n]*\\n', '') FROM gp)"""



def _one_line(x: str) -> str:
    return _trim(f"regexp_replace(nfc_normalize(coalesce({x}, '')), '{_WS}+', ' ', 'g')")


_BYTES = "".join(f"chr({i})" + " || " * (i < 127) for i in range(1, 128))


def _edits(source: str, keep: str) -> str:
    """CTEs ending in ``ed``: ``keep``, x, y and the edit distance n of the columns x and y of ``source``, in characters."""
    return f"""
e0 AS (SELECT {keep}, x, y, array_to_string(list_distinct(string_split(x || y, '')), '') AS cs FROM {source}),
ed AS (SELECT {keep}, x, y, levenshtein(translate(x, cs, substring({_BYTES}, 1, length(cs))), translate(y, cs, substring({_BYTES}, 1, length(cs)))) AS n FROM e0)"""


_CER = f"""{_GOLD},
cp AS (SELECT ou.document_id, ou.page_no, engine, {_one_line('g.gold_text')} AS x, {_one_line('ou.text')} AS y FROM ou JOIN gold_pages g ON g.document_id = ou.document_id AND g.page_no = ou.page_no AND g.gold_text IS NOT NULL),
{_edits('cp', 'document_id, page_no, engine')},
ce AS (SELECT document_id, page_no, engine, CASE WHEN length(x) > 0 THEN n / length(x) END AS cer FROM ed)"""
_PAIRS = f"""{_GOLD},
pp AS (SELECT a.document_id, a.page_no, a.engine AS engine_a, b.engine AS engine_b, {_one_line('a.text')} AS x, {_one_line('b.text')} AS y FROM ou a JOIN ou b ON a.document_id = b.document_id AND a.page_no = b.page_no AND a.engine < b.engine),
{_edits('pp', 'document_id, page_no, engine_a, engine_b')},
co AS (SELECT document_id, page_no, engine_a, engine_b, round(1 - n / greatest(length(x), length(y), 1), 6) AS similarity FROM ed),
ow AS (SELECT * FROM co WHERE engine_a <> 'textlayer' AND engine_b <> 'textlayer')"""

_SCORED = f"""{_C},
be AS (SELECT document_id, count(*) / (1.0::DOUBLE + max(page_no) + count(*)) AS best FROM c GROUP BY document_id),
s AS (SELECT NOT review_required AS answerable, best FROM documents d LEFT JOIN be ON be.document_id = d.id)"""
_SWEEP = f"""{_SCORED},
cu AS (SELECT DISTINCT round_even(best, 3) AS cutoff FROM s WHERE best IS NOT NULL UNION SELECT min(round_even(best, 3)) - 0.5 FROM s WHERE best IS NOT NULL),
sw AS (
  SELECT cutoff, count(*) FILTER (answerable AND best >= cutoff) AS answered, count(*) FILTER (answerable) - count(*) FILTER (answerable AND best >= cutoff) AS missed,
         count(*) FILTER (NOT answerable) - count(*) FILTER (NOT answerable AND best >= cutoff) AS rejected, count(*) FILTER (NOT answerable AND best >= cutoff) AS leaked
  FROM cu, (SELECT answerable, best, count(*) AS m FROM s GROUP BY ALL) x, LATERAL (SELECT unnest(range(m))) y GROUP BY cutoff)"""

_PAGE = "document_id, page_no"
_EVENTS = "".join("\\" + c if c in "[](){}?" else c for c in TERMINATORS + OPENERS + CLOSERS)

_POINTS = f"""
{_C}, fi AS (SELECT vectors_path, arg_max(model, created_at) AS model, arg_max(dim, created_at) AS dim FROM document_embeddings GROUP BY 1),
vv AS (SELECT chunk_id, arg_max(model, (vectors_path, row_no)) AS model, arg_max(dense, (vectors_path, row_no)) AS dense FROM vector_rows JOIN fi USING (vectors_path) WHERE len(dense) = dim GROUP BY 1),
hh AS (SELECT c.*, vv.model, vv.dense, sha1(unhex('6f1d3c2e4a5b4c7d8e9f0a1b2c3d4e5f') || encode(c.id)) AS h FROM vv JOIN c ON c.id = vv.chunk_id),
bp AS (
  SELECT substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || substring('89ab', (('0x' || substring(h, 17, 1))::INTEGER & 3) + 1, 1) || substring(h, 18, 3) || '-' || substring(h, 21, 12) AS point_id,
         hh.dense, hh.id AS chunk_id, document_id, filename, language, page_no, ordinal, char_start, char_end, hh.text AS text, model FROM hh LEFT JOIN documents d ON d.id = hh.document_id)"""

ORACLE = {
    "dedupe_uploads": """
SELECT id, kept_id, id = kept_id AS created FROM (
  SELECT id, CASE WHEN sha256 IS NULL THEN id ELSE first_value(id) OVER (PARTITION BY sha256 ORDER BY uploaded_at ASC NULLS LAST, id) END AS kept_id FROM documents)""",
    "document_listing": "SELECT id, filename, substring(sha256, 1, 12) AS sha12, byte_size, page_count, language, review_required, review_note, uploaded_at FROM documents",
    "review_queue": "SELECT id, filename, review_note, uploaded_at FROM documents WHERE review_required",
    "page_details": f"WITH {_P} SELECT {_PAGE}, source, ocr_engine, trustworthy, length(text) AS chars FROM p",
    "page_text": f"WITH {_P} SELECT {_PAGE}, coalesce(raw_text, '') AS raw, coalesce(text, '') AS normal FROM p",
    "decode_quality": f"""
WITH {_P}, j AS (SELECT {_PAGE}, CASE WHEN json_valid(quality) THEN quality::JSON END AS q FROM p)
SELECT {_PAGE}, q IS NOT NULL AS valid, {', '.join(f"try_cast(q->>'{m}' AS DOUBLE) AS {m}" for m in ('bengali_ratio', 'initial_dependent_rate', 'triple_letter_runs', 'tokens', 'chars'))},
       try_cast(q->>'fonts_ok' AS BOOLEAN) AS fonts_ok FROM j""",
    "pages_needing_ocr": f"WITH {_P} SELECT {_PAGE}, source FROM p WHERE source IN ('needs_ocr', 'empty')",
    "documents_without_text": f"""
WITH {_P} SELECT document_id, count(*) AS pages, array_to_string(list_slice(list(page_no ORDER BY page_no), 1, 5), ',') AS first_pages FROM p
WHERE source IN ('needs_ocr', 'empty') GROUP BY document_id""",
    "pages_by_source": f"WITH {_P} SELECT source, count(*) AS pages, count(*) FILTER (trustworthy) AS usable FROM p GROUP BY source",
    "usable_pages": f"WITH {_P} SELECT {_PAGE} FROM p WHERE text IS NOT NULL AND coalesce(trustworthy, false)",
    "script_ratio": f"""
WITH {_P} SELECT {_PAGE}, round(CASE WHEN v > 0 THEN b / v ELSE 0 END, 6) AS ratio
FROM (SELECT {_PAGE}, {_count('raw_text', _NWS)} AS v, {_count('raw_text', _BN)} AS b FROM p WHERE raw_text IS NOT NULL)""",
    "orthographic_report": f"""
WITH {_P}, {_ortho('raw_text', '(SELECT * FROM p WHERE raw_text IS NOT NULL)')}
SELECT {_PAGE}, tokens, len(bad) AS initial_dependent, round(rate, 6) AS rate, array_to_string(bad[1:8], ' ') AS samples, triples, orphaned, rate > 0.005 OR triples > 0 AS corrupt FROM o""",
    "latin_intrusion": f"""
WITH {_P}, l AS (SELECT {_PAGE}, {_LATIN.format('raw_text')} AS w, len({_tokens('raw_text')}) AS n FROM p WHERE raw_text IS NOT NULL)
SELECT {_PAGE}, len(w) AS latin, len(w) + n AS total, round(CASE WHEN len(w) + n > 0 THEN len(w) / (len(w) + n) ELSE 0 END, 6) AS rate, array_to_string(w[1:8], ' ') AS samples FROM l""",
    "nfc_normalize": f"WITH {_P} SELECT {_PAGE}, nfc_normalize(raw_text) AS normal, nfc_normalize(raw_text) <> raw_text AS changed FROM p WHERE raw_text IS NOT NULL",
    "triage_source": f"WITH {_P}, {_TRIAGE} SELECT {_PAGE}, source, CASE WHEN source = 'textlayer' THEN raw_text END AS kept_text FROM tr",
    "triage_counts": f"WITH {_P}, {_TRIAGE} SELECT source, count(*) AS pages FROM tr GROUP BY source",
    "page_measures": f"""
WITH {_P}, {_ortho('raw_text', '(SELECT * FROM p WHERE raw_text IS NOT NULL)')}
SELECT {_PAGE}, tokens, len(bad) AS initial_dependent, triples AS triple_letter_runs, orphaned AS orphaned_signs, length(t) AS chars FROM o""",
    "validity_gate": f"WITH {_P}, {_GATE} SELECT * FROM g",
    "document_hold": f"""
WITH {_P}, {_GATE}, d AS (
  SELECT document_id, count(*) AS pages, count(*) FILTER (trustworthy) AS ok, count(*) FILTER (NOT trustworthy) AS bad, sum(chars)::BIGINT AS total_chars, count(*) FILTER (latin_suspect) AS latin,
         list(page_no ORDER BY page_no) FILTER (NOT trustworthy) AS bp, list(page_no ORDER BY page_no) FILTER (latin_suspect) AS lp FROM g GROUP BY document_id),
nt AS (SELECT *, CASE WHEN bad > 0 THEN bad || ' page(s) failed the text check (pages ' || array_to_string(bp[1:8], ', ') || ')' END AS review_note FROM d)
SELECT document_id, pages, ok AS trustworthy, bad AS failed, total_chars, latin AS latin_suspect, coalesce(array_to_string(bp[1:50], ','), '') AS failed_pages,
       CASE WHEN bad > 0 THEN 'held' ELSE 'succeeded' END AS status, bad > 0 AS review_required, review_note,
       coalesce(review_note, ok || ' of ' || pages || ' pages passed the text check' || CASE WHEN latin > 0 THEN '; Latin words intrude on ' || latin || ' page(s) (pages ' || array_to_string(lp[1:5], ', ') || ')' ELSE '' END) AS note
FROM nt""",
    "probe_verdict": f"""
WITH {_P}, f6 AS (
  SELECT document_id, string_agg(coalesce(raw_text, ''), chr(10) ORDER BY page_no) AS raw_text, max(length({_trim("coalesce(raw_text, '')")})) AS longest,
         bool_or(NOT coalesce({_FONTS}, true)) AS bad_font FROM p WHERE page_no <= 6 GROUP BY document_id),
{_ortho('raw_text', 'f6', 'document_id, longest, bad_font')}
SELECT document_id, CASE WHEN bad_font OR rate > 0.005 OR triples > 0 THEN 'UNTRUSTWORTHY'
  WHEN CASE WHEN v > 0 THEN b / v ELSE 0 END < 0.4 AND v > 50 THEN 'NOT BENGALI' WHEN longest < 20 THEN 'NO TEXT LAYER' ELSE 'plausible' END AS verdict
FROM (SELECT *, {_count('t', _NWS)} AS v, {_count('t', _BN)} AS b FROM o)""",
    "bad_fonts": f"""
WITH {_P}, f AS (SELECT unnest(from_json(json_extract(CASE WHEN json_valid(quality) THEN quality::JSON END, '$.bad_fonts'), '["VARCHAR"]')) AS font FROM p)
SELECT substring(regexp_replace(font, '^[^+]*\\+', ''), 1, 24) AS font, count(*) AS pages, max(CASE WHEN regexp_matches(font, '(?i)(MJ\\b|SutonnyMJ|Bijoy|Boishakhi)') THEN 1 ELSE 0 END) AS legacy FROM f GROUP BY 1""",
    "paragraph_counts": f"""
WITH {_P}, s AS (SELECT {_PAGE}, list_filter(regexp_split_to_array(text, '\\n{_WS}*\\n'), lambda x: regexp_matches(x, '{_NWS}')) AS f FROM p WHERE text IS NOT NULL)
SELECT {_PAGE}, len(f) AS paragraphs, coalesce(list_max(list_transform(f, lambda x: length(x))), 0) AS longest FROM s""",
    "sentence_ends": f"""
WITH {_P}, e0 AS (SELECT {_PAGE}, regexp_extract_all(text || ' ', '[{_EVENTS}]{_WS}?') AS t FROM p WHERE text IS NOT NULL),
e AS (SELECT {_PAGE}, unnest(t) AS t, generate_subscripts(t, 1) AS i FROM e0),
d AS (SELECT *, CASE WHEN strpos('{OPENERS}', left(t, 1)) > 0 THEN 1 WHEN strpos('{CLOSERS}', left(t, 1)) > 0 THEN -1 ELSE 0 END AS d FROM e),
c AS (SELECT *, sum(d) OVER (PARTITION BY {_PAGE} ORDER BY i) AS c FROM d),
m AS (SELECT *, c - least(0, min(c) OVER (PARTITION BY {_PAGE} ORDER BY i)) AS depth FROM c),
n AS (SELECT {_PAGE}, count(*) AS n FROM m WHERE d = 0 AND depth = 0 AND length(t) = 2 GROUP BY ALL)
SELECT e0.document_id, e0.page_no, coalesce(n, 0) AS ends FROM e0 LEFT JOIN n USING (document_id, page_no)""",
    "chunk_metrics": f"""
WITH {_P}, {_C}, own AS (
  SELECT document_id, list(page_no ORDER BY page_no) FILTER (bad) AS skipped, count(*) FILTER (bad) AS pages_skipped
  FROM (SELECT *, text IS NULL OR NOT coalesce(trustworthy, false) AS bad FROM p) GROUP BY document_id),
z AS (SELECT document_id, count(*) AS chunks, count(DISTINCT page_no) AS pages_chunked, avg(char_end - char_start) AS m, min(char_end - char_start) AS lo, max(char_end - char_start) AS hi FROM c GROUP BY document_id)
SELECT document_id, coalesce(chunks, 0) AS chunks, coalesce(pages_chunked, 0) AS pages_chunked, pages_skipped, coalesce(array_to_string(skipped[1:50], ','), '') AS skipped,
       round_even(coalesce(m, 0), 1) AS mean_chars, coalesce(lo, 0) AS min_chars, coalesce(hi, 0) AS max_chars FROM own LEFT JOIN z USING (document_id)""",
    "page_report": f"""
WITH {_P}, {_C}, z AS (SELECT {_PAGE}, count(*) AS chunks, string_agg((char_end - char_start)::VARCHAR, ',' ORDER BY ordinal, char_end - char_start) AS sizes FROM c GROUP BY ALL)
SELECT {_PAGE}, CAST(length(p.text) AS INTEGER) AS page_chars, chunks, sizes FROM p JOIN z USING (document_id, page_no)""",
    "lead_ins": f"""
WITH {_C} SELECT id, CASE WHEN prev IS NULL THEN char_start ELSE greatest(prev, char_start - 60) END AS embed_start FROM (
  SELECT id, char_start, lag(char_start) OVER (PARTITION BY {_PAGE} ORDER BY ordinal, id) AS prev FROM c)
""",
    "replace_chunks": f"""
WITH {_P}, {_C}, x AS (SELECT id FROM documents WHERE review_required), fr AS (SELECT document_id, page_no, CAST(length(text) AS INTEGER) AS n FROM p WHERE text IS NOT NULL AND document_id IN (SELECT id FROM x))
SELECT id, document_id, page_no, char_end FROM c WHERE document_id NOT IN (SELECT document_id FROM fr)
UNION ALL SELECT document_id || ':' || page_no || ':0', document_id, page_no, n FROM fr""",
    "hashed_embed": f"""
WITH {_C}, h AS (
  SELECT id, array_to_string(list_transform(range(16), lambda i: sha256(encode(coalesce(embed_text, '')) || unhex(printf('%04x', i)))), '') AS h FROM c),
v AS (SELECT id, list_transform(range(256), lambda i: ('0x' || substring(h, 4 * i + 1, 4))::INTEGER / 32767.5 - 1) AS v FROM h),
u AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v)
SELECT id, list_transform(list_transform(v, lambda x: round(x / n, 6)), lambda x: CASE WHEN x = 0 THEN 0 ELSE x END) AS dense, len(v) AS dim FROM u""",
    "l2_normalize": """
WITH v AS (SELECT DISTINCT vectors_path, row_no, dense::DOUBLE[] AS v FROM vector_rows WHERE dense IS NOT NULL),
n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v)
SELECT vectors_path, row_no, list_transform(list_transform(v, lambda x: round(CASE WHEN n = 0 THEN x ELSE x / n END, 5)), lambda x: CASE WHEN x = 0 THEN 0 ELSE x END) AS unit FROM n""",
    "embed_stage": f"""
WITH {_E}, v AS (SELECT vectors_path, count(*) AS rows, count(DISTINCT coalesce(len(dense), -1)) - max(CASE WHEN dense IS NULL THEN 1 ELSE 0 END) AS widths, max(len(dense)) AS width FROM (SELECT DISTINCT * FROM vector_rows) GROUP BY 1)
SELECT document_id, model, rows, widths, rows = n_chunks AND widths = 1 AND width = dim AS sound FROM e JOIN v USING (vectors_path)""",
    "point_ids": f"""
WITH {_C}, h AS (SELECT id, sha1(unhex('6f1d3c2e4a5b4c7d8e9f0a1b2c3d4e5f') || encode(id)) AS h FROM c)
SELECT id, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || substring('89ab', (('0x' || substring(h, 17, 1))::INTEGER & 3) + 1, 1) || substring(h, 18, 3) || '-' || substring(h, 21, 12) AS point_id FROM h""",
    "collection_info": "SELECT 'pages_main' AS name, count(*) > 0 AS found, max(dim) AS dim FROM vector_collections WHERE name = 'pages_main' UNION ALL SELECT 'absent', count(*) > 0, max(dim) FROM vector_collections WHERE name = 'absent'",
    "ensure_collection": "SELECT name, CASE WHEN name = 'pages_old' THEN 'bhashaki-small:64' ELSE model END AS model, CAST(CASE WHEN name = 'pages_old' THEN 128 ELSE dim END AS INTEGER) AS dim, true AS created FROM vector_collections",
    "build_points": f"WITH {_POINTS} SELECT * FROM bp",
    "index_checks": """
WITH fi AS (SELECT vectors_path, arg_max(document_id, created_at) AS document_id, arg_max(dim, created_at) AS dim FROM document_embeddings GROUP BY 1),
r AS (SELECT DISTINCT vectors_path, row_no, chunk_id, len(dense) AS width FROM vector_rows),
a AS (SELECT document_id, count(*) AS rows, count(*) FILTER (width <> dim) AS wrong_width, count(*) FILTER (NOT known) AS missing_chunks, min(chunk_id) FILTER (NOT known) AS example
      FROM (SELECT r.*, fi.*, EXISTS (SELECT 1 FROM chunks c WHERE c.id = r.chunk_id) AS known FROM r JOIN fi USING (vectors_path)) GROUP BY 1)
SELECT * FROM a WHERE wrong_width > 0 OR missing_chunks > 0""",
    "model_changes": f"WITH {_E} SELECT document_id, model FROM e WHERE model IS DISTINCT FROM 'bhashaki-small:64'",
    "upsert_points": "SELECT vec_id, CAST(CASE WHEN label = 3 THEN 13 ELSE label END AS INTEGER) AS label, embedding FROM embeddings",
    "delete_document": f"WITH {_POINTS} SELECT point_id, document_id, chunk_id, dense FROM bp WHERE document_id IS DISTINCT FROM (SELECT min(id) FROM documents)",
    "point_counts": f"WITH {_POINTS} SELECT document_id, count(*) AS points FROM bp GROUP BY document_id",
    "citations": f"WITH {_POINTS} SELECT chunk_id, filename, page_no, char_start, char_end FROM bp",
    "retrieve": f"""
WITH t AS (SELECT b.vec_id AS chunk_id, b.label, {_DOT} AS score FROM embeddings a, embeddings b WHERE a.vec_id = 7 ORDER BY {_DOT} DESC, b.vec_id LIMIT 8)
SELECT chunk_id, label, round(score, 6) AS gate_score FROM t""",
    "dense_topk": f"SELECT b.vec_id, b.label, round({_DOT}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 ORDER BY {_DOT} DESC, b.vec_id LIMIT 20",
    "dense_topk_filtered": f"SELECT b.vec_id, b.label, round({_DOT}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.label = 2 ORDER BY {_DOT} DESC, b.vec_id LIMIT 20",
    "knn_batch": f"WITH {_KNN.format(k=10)} SELECT q, p, round(score, 6) AS score FROM kn",
    "model_guard": f"WITH {_CAND} SELECT question, count(*) AS kept FROM ca WHERE model IN ('', 'm-even') GROUP BY question",
    "rerank_sort": f"""
WITH {_CAND}, g AS (SELECT *, coalesce(rerank_score, score) AS gate_score FROM ca)
SELECT question, CAST(row_number() OVER w AS INTEGER) AS place, chunk_id, gate_score FROM g QUALIFY row_number() OVER w <= 8 WINDOW w AS (PARTITION BY question ORDER BY gate_score DESC, score DESC, chunk_id)""".replace(
        " FROM g QUALIFY row_number() OVER w <= 8 WINDOW w AS (PARTITION BY question ORDER BY gate_score DESC, score DESC, chunk_id)",
        " FROM g WINDOW w AS (PARTITION BY question ORDER BY gate_score DESC, score DESC, chunk_id) QUALIFY row_number() OVER w <= 8"),
    "score_range": f"""
WITH {_CAND}, g AS (SELECT *, coalesce(rerank_score, score) AS gate_score FROM ca)
SELECT question, count(*) AS candidates, max(gate_score) AS best_score, round_even(min(gate_score), 4) AS low, round_even(max(gate_score), 4) AS high FROM g GROUP BY question""",
    "token_overlap": f"""
WITH {_P}, {_C}, j AS (SELECT c.id, {_CLAIM_TOKENS.format('c.text')} AS ct, {_CLAIM_TOKENS.format('p.text')} AS st FROM c JOIN p ON p.document_id = c.document_id AND p.page_no = c.page_no WHERE c.text IS NOT NULL AND p.text IS NOT NULL)
SELECT id, len(ct) AS tokens, round(CASE WHEN len(ct) > 0 THEN len(list_filter(ct, lambda w: list_contains(st, w))) / len(ct) ELSE 0 END, 6) AS overlap FROM j""",
    "span_numbers": f"WITH {_QUESTIONS} SELECT question, span_id, chunk_id FROM sp",
    "span_blocks": f"WITH {_QUESTIONS} SELECT question, string_agg('[' || span_id || '] (page ' || page_no || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY n) AS span_block FROM sp GROUP BY question",
    "abstain_gate": f"WITH {_QUESTIONS}, {_BEST} SELECT question, round(best, 6) AS best_score, {_REASON} AS abstain_reason FROM dq LEFT JOIN gs USING (question)",
    "citation_check": f"WITH {_QUESTIONS} SELECT question, pos, span_id, chunk_id, bround3 AS quote_overlap, grounded FROM k",
    "answer_outcome": f"WITH {_OUTCOME} SELECT * FROM ans",
    "outcome_counts": f"WITH {_OUTCOME} SELECT answered, count(*) AS questions, sum(claims_grounded)::BIGINT AS claims_grounded FROM ans GROUP BY answered",
    "threshold_sweep": f"WITH {_SWEEP} SELECT * FROM sw",
    "best_cutoff": f"WITH {_SWEEP} SELECT * FROM sw WHERE leaked = 0 ORDER BY cutoff LIMIT 1",
    "ocr_signals": f"""
WITH {_GOLD}, t AS (SELECT document_id, page_no, engine, {_trim(f"regexp_replace(nfc_normalize(coalesce(text, '')), '{_WS}+', ' ', 'g')")} AS raw_text FROM ou), {_ortho('raw_text', 't', 'document_id, page_no, engine')}
SELECT document_id, page_no, engine, length(t) AS chars, tokens, round(CASE WHEN {_count('t', _NWS)} > 0 THEN {_count('t', _BN)} / {_count('t', _NWS)} ELSE 0 END, 6) AS ratio, round(rate, 6) AS rate, triples FROM o""",
    "cer_scores": f"WITH {_CER} SELECT document_id, page_no, engine, round(cer, 6) AS cer FROM ce",
    "high_error": f"WITH {_CER} SELECT document_id, page_no, engine, round(cer, 6) AS cer FROM ce WHERE cer > 1",
    "consensus": f"WITH {_PAIRS} SELECT * FROM co",
    "worst_pairs": f"WITH {_PAIRS} SELECT document_id, page_no, arg_min(engine_a, (similarity, engine_a, engine_b)) AS engine_a, arg_min(engine_b, (similarity, engine_a, engine_b)) AS engine_b, min(similarity) AS similarity FROM ow GROUP BY ALL",
    "mean_agreement": f"""
WITH {_PAIRS}, b AS (SELECT document_id, page_no, engine_a AS engine, similarity FROM ow UNION ALL SELECT document_id, page_no, engine_b, similarity FROM ow)
SELECT document_id, page_no, engine, round(avg(similarity), 6) AS agreement FROM b GROUP BY ALL""",
    "side_by_side": f"""
WITH {_GOLD} SELECT document_id, page_no, string_agg('--- ' || engine || ' ---' || chr(10) || array_to_string(string_split(coalesce(text, ''), chr(10))[1:12], chr(10)), chr(10) || chr(10) ORDER BY engine) AS compared FROM ou GROUP BY ALL""",
    "ocr_totals": f"""
WITH {_P}, o AS (SELECT document_id, page_no, length(raw_text) / 1000 AS seconds, coalesce(length({_trim('raw_text')}), 0) = 0 AS bad FROM p WHERE source = 'ocr')
SELECT document_id, count(*) FILTER (NOT bad) AS pages_read, round_even(coalesce(sum(seconds) FILTER (NOT bad), 0), 1) AS total_seconds, count(*) FILTER (bad) AS failed,
       coalesce(array_to_string((list(page_no ORDER BY page_no) FILTER (bad))[1:3], ','), '') AS failed_pages, CASE WHEN count(*) FILTER (bad) > 0 THEN 'failed' ELSE 'succeeded' END AS status FROM o GROUP BY document_id""",
    "engine_means": f"WITH {_P} SELECT coalesce(ocr_engine, 'none') AS engine, count(*) AS pages, round(avg(length(raw_text)), 4) AS mean_chars FROM p WHERE source = 'ocr' GROUP BY 1",
    "ocr_uncached": f"WITH {_P} SELECT {_PAGE} FROM p WHERE source IN ('needs_ocr', 'empty') OR (source = 'ocr' AND ocr_engine IS DISTINCT FROM 'tesseract')",
    "ensure_stage_runs": f"WITH {_RUNS} SELECT document_id, stage, status, attempt FROM f",
    "stage_blockers": f"""
WITH {_RUNS} SELECT document_id, stage, status, blockers, (status IN ('pending', 'stale') OR (status = 'failed' AND attempt < 3)) AND blockers = '' AS auto,
       status NOT IN ('running', 'succeeded') AND blockers = '' AS manual, status <> 'running' AND blockers = '' AS forced FROM bl""",
    "next_runnable": f"WITH {_RUNS} SELECT document_id, arg_min(stage, pos) AS stage FROM bl WHERE blockers = '' AND (status IN ('pending', 'stale') OR (status = 'failed' AND attempt < 3)) GROUP BY document_id",
    "mark_stale": f"""
WITH {_RUNS}, n AS (SELECT DISTINCT document_id FROM r WHERE stage = 'normalize')
SELECT r.document_id, stage, CASE WHEN n.document_id IS NOT NULL AND pos > 3 AND status IN ('succeeded', 'failed', 'held', 'skipped') THEN 'stale' ELSE status END AS status, attempt FROM r LEFT JOIN n USING (document_id)""",
    "stage_counts": f"WITH {_RUNS} SELECT stage, status, count(*) AS runs, sum(attempt)::BIGINT AS attempts FROM r GROUP BY ALL",
    "run_stage": f"""
WITH {_RUNS}, go AS (SELECT document_id FROM bl WHERE stage = 'normalize' AND status NOT IN ('running', 'succeeded') AND blockers = '')
SELECT f.document_id, stage, CASE WHEN go.document_id IS NULL OR pos < 3 THEN status WHEN pos = 3 THEN 'succeeded' WHEN status IN ('succeeded', 'failed', 'held', 'skipped') THEN 'stale' ELSE status END AS status,
       CAST(attempt + CASE WHEN go.document_id IS NOT NULL AND pos = 3 THEN 1 ELSE 0 END AS INTEGER) AS attempt FROM f LEFT JOIN go USING (document_id)""",
    "advance_stages": f"""
WITH {_RUNS}, fi AS (SELECT document_id, min(pos) FILTER (status NOT IN ('succeeded', 'skipped')) AS first FROM f GROUP BY 1),
ok AS (SELECT f.document_id, first FROM f JOIN fi ON f.document_id = fi.document_id AND f.pos = first WHERE status IN ('pending', 'stale') OR (status = 'failed' AND attempt < 3)),
ru AS (SELECT ok.document_id, first, coalesce(min(pos) FILTER (status = 'running' AND pos > first), 7) AS stop FROM ok JOIN f USING (document_id) GROUP BY 1, 2),
nx AS (
  SELECT f.document_id, CASE WHEN first IS NULL OR pos < first THEN status WHEN pos < stop THEN 'succeeded' WHEN status IN ('succeeded', 'failed', 'held', 'skipped') THEN 'stale' ELSE status END AS status,
         attempt + CASE WHEN pos >= first AND pos < stop THEN 1 ELSE 0 END AS attempt FROM f LEFT JOIN ru USING (document_id))
SELECT document_id, count(*) FILTER (status IN ('succeeded', 'skipped')) = 6 AS done, bool_or(status = 'held') AS held, count(*) FILTER (status = 'failed') AS failed, sum(attempt)::BIGINT AS attempts FROM nx GROUP BY 1""",
    "latest_events": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS events FROM events GROUP BY user_id",
    "delete_cascade": f"""
WITH {_P}, {_C}, {_E}, x AS (SELECT id FROM documents WHERE review_required)
SELECT 'documents' AS "table", count(*) AS rows FROM documents WHERE id NOT IN (SELECT id FROM x)
UNION ALL SELECT 'document_pages', count(*) FROM p WHERE document_id NOT IN (SELECT id FROM x)
UNION ALL SELECT 'chunks', count(*) FROM c WHERE document_id NOT IN (SELECT id FROM x)
UNION ALL SELECT 'document_embeddings', count(*) FROM e WHERE document_id NOT IN (SELECT id FROM x)""",
}
