"""DuckDB SQL for the queries of plans.queries, over the same Parquet tables."""

from __future__ import annotations

from parchment import config as C
from parchment.functions import text as T
from parchment.operators.anonymise import PATTERNS
from parchment.operators.evaluation import GOLDEN


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: Documents with structure that the tables lack, in SQL that both engines read: headings, page breaks, hyphens, furniture, tags.
STRUCTURED = """
SELECT doc_id, source, concat(
  CASE WHEN doc_id % 5 = 0 THEN concat('2.', CAST(doc_id % 9 AS STRING), ' Titel der Sektion', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 7 = 1 THEN concat('## Abschnitt ', CAST(doc_id AS STRING), ' ##', chr(10)) ELSE '' END,
  coalesce(text, ''),
  CASE WHEN doc_id % 3 = 0 THEN concat(chr(10), 'Inhalt ........ 12', chr(10), 'MS ID/Ver 1', chr(10), '12', chr(10), 'Folie 4', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 4 = 0 THEN concat(chr(10), chr(12), chr(10), 'Silben-', chr(10), '  trennung  der Werktage binnen 5 Tagen; ZUSTÄNDIG ist die Stelle, mindestens CHF 20', chr(39), '000.', chr(10), '8. Juni 2026') ELSE '' END,
  CASE WHEN doc_id % 11 = 2 THEN concat(chr(10), '/0 /1 /2 ', repeat('/17 /4 ', 200)) ELSE '' END
) AS text FROM documents
"""
#: Texts in plain ASCII, so that word boundaries are the same in every engine, with numbers made from the id.
NUMBERED = """
SELECT doc_id, concat(regexp_replace(coalesce(text, ''), '[^ -~]', '?'{g}),
  ' Pers-Nr. ', CAST(1000000 + doc_id AS STRING), ' und CHE-123.456.', CAST(100 + doc_id % 900 AS STRING),
  CASE WHEN doc_id % 2 = 0 THEN ' 756.9217.0769.85' ELSE ' 756.9217.0769.84' END,
  CASE WHEN doc_id % 3 = 0 THEN ' CH9300762011623852957' ELSE ' CH9300762011623852958' END,
  ' bei ', CAST(2400000 + doc_id * 997 % 500000 AS STRING), '.5 / 1', CAST(100000 + doc_id * 31 % 250000 AS STRING),
  ' und 6', CAST(10000 + doc_id % 90000 AS STRING), ', ', CAST(100000 + doc_id % 150000 AS STRING),
  ' 46.94809, 7.44744 ar-D-3DD93401/1644 +41 58 465 12 34 hans.muster@bit.example.ch') AS text FROM documents
"""
S = T.SPACE


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^[{S}]+|[{S}]+$')}, '', 'g')"


def has(x: str, rx: str) -> str:
    return f"regexp_matches({x}, {q(rx)})"


def toks(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {q(T.TOKEN)})"


JOINED = f"regexp_replace(replace(text, chr(173), ''), {q(f'-[{S}]*{chr(92)}n[{S}]*')}, '', 'g')"
LINES = f"""list_transform(list_filter(list_transform(string_split({JOINED}, chr(10)), lambda x: CASE WHEN x = chr(12) THEN x ELSE {strip("x")} END),
  lambda x: x = chr(12) OR (x <> '' AND NOT {has("x", T.CONTENTS_LINE)} AND NOT {has("x", T.HEADER_LINE)} AND NOT {has("x", T.NUMBER_LINE)} AND NOT {has("x", T.FOOTER_LINE)})),
  lambda x: regexp_replace(x, '[ \\t]{{2,}}', ' ', 'g'))"""
_num = lambda i: f"regexp_extract(x, {q(T.NUMBERED_HEADING)}, {i})"
_FLUSH = lambda chunks, cur, head: f"CASE WHEN length({strip(cur)}) >= {C.CHUNK_MIN} THEN list_append({chunks}, CASE WHEN {head} <> '' THEN {head} || ': ' ELSE '' END || {strip(cur)}) ELSE {chunks} END"
#: Chunks by a recursion over each document's lines.
CHUNKS = f"""
docs AS ({STRUCTURED}),
kinds AS (SELECT doc_id, source, i, x, CASE WHEN x = chr(12) THEN 'page' WHEN {has("x", T.NUMBERED_HEADING)} AND {has(_num(2), "[a-zäöü]")} THEN 'num' WHEN {has("x", T.MARKED_HEADING)} THEN 'md' ELSE 'line' END AS kind
  FROM (SELECT doc_id, source, generate_subscripts(l, 1) AS i, unnest(l) AS x FROM (SELECT doc_id, source, {LINES} AS l FROM docs))),
lines AS (SELECT doc_id, source, i, kind, CASE WHEN kind = 'md' THEN {strip(f"regexp_extract(x, {q(T.MARKED_HEADING)}, 2)")} ELSE x END AS line,
  CASE kind WHEN 'num' THEN {strip(f"{_num(1)} || ' ' || {_num(2)}")} WHEN 'md' THEN {strip(f"regexp_extract(x, {q(T.MARKED_HEADING)}, 2)")} ELSE '' END AS hd FROM kinds),
fold AS (
  SELECT doc_id, source, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS chunks, CAST('' AS VARCHAR) AS cur, CAST('' AS VARCHAR) AS head, CAST(0 AS BIGINT) AS size FROM docs
  UNION ALL
  SELECT f.doc_id, f.source, l.i,
    CASE WHEN kind <> 'line' THEN {_FLUSH("f.chunks", "f.cur", "f.head")} WHEN ends THEN {_FLUSH("chunks1", "cur1", "f.head")} ELSE chunks1 END,
    CASE WHEN kind = 'page' OR ends THEN '' WHEN kind <> 'line' THEN l.line ELSE cur1 END,
    CASE WHEN kind = 'line' THEN f.head ELSE l.hd END,
    CASE WHEN kind = 'page' OR ends THEN 0 WHEN kind <> 'line' THEN length(l.line) ELSE size1 END
  FROM fold f JOIN lines l ON l.doc_id = f.doc_id AND l.i = f.i + 1,
    LATERAL (SELECT f.size + length(l.line) > {C.CHUNK_HARD} AS over) o,
    LATERAL (SELECT CASE WHEN over THEN {_FLUSH("f.chunks", "f.cur", "f.head")} ELSE f.chunks END AS chunks1, CASE WHEN over OR f.cur = '' THEN l.line ELSE f.cur || ' ' || l.line END AS cur1, CASE WHEN over THEN 0 ELSE f.size END + length(l.line) + 1 AS size1) s,
    LATERAL (SELECT kind = 'line' AND size1 >= {C.CHUNK_TARGET} AND right(l.line, 1) IN ('.', ';', ':') AS ends) e
),
packed AS (SELECT doc_id, any_value(source) AS source, {_FLUSH("arg_max(chunks, i)", "arg_max(cur, i)", "arg_max(head, i)")} AS chunks FROM fold GROUP BY doc_id),
plain_chunks AS (SELECT doc_id, source, generate_subscripts(chunks, 1) - 1 AS ord, unnest(chunks) AS text FROM packed),
chunks AS (SELECT doc_id, source, ord, text, list_filter([{", ".join(f"CASE WHEN {has('text', '(?i)' + rx)} THEN {q(tag)} END" for tag, rx in T.TAGS.items())}], lambda t: t IS NOT NULL) AS tags FROM plain_chunks)"""
METRICS = """CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '\\P{L}', '', 'g')) / length(text) ELSE 1.0 END AS alpha,
  CASE WHEN length(text) > 0 THEN len(regexp_extract_all(text, '\\p{L}{3,}')) * 100.0 / length(text) ELSE 100.0 END AS density,
  CASE WHEN length(text) > 0 THEN len(regexp_extract_all(text, '[\\x{fffd}\\x{80}-\\x{9f}]')) * 1.0 / length(text) ELSE 0.0 END AS broken"""
GARBAGE = f"(alpha < {C.GARBAGE_ALPHA} AND density < {C.GARBAGE_DENSITY}) OR broken > {C.GARBAGE_MOJIBAKE}"
POSTINGS = f"postings AS (SELECT doc_id AS id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM (SELECT doc_id, {toks('coalesce(text, chr(32))')} AS t FROM documents)) GROUP BY ALL)"
IDF = f"""{POSTINGS}, stats AS (SELECT count(*) AS n, sum(len({toks('coalesce(text, chr(32))')})) / count(*) AS avgdl FROM documents),
terms AS (SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), stats)"""
QUESTIONS = "questions AS (SELECT item_id AS qid, text AS question, text AS answer, concat('sheet', CAST(item_id % 4 AS STRING)) AS sheet FROM benchmark)"
GOLDEN_SET = "questions AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}', '{x.replace(chr(39), chr(39) * 2)}')" for i, (q, x) in enumerate(GOLDEN)) + ") AS v(qid, question, expected))"
BM25 = f"""asked AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({toks('question')}) AS term FROM questions) GROUP BY ALL),
bm AS (SELECT qid, id, round(sum(qtf * idf * tf * {C.BM25_K1 + 1} / (tf + {C.BM25_K1} * (1 - {C.BM25_B} + {C.BM25_B} * dl / avgdl))), 6) AS score FROM postings JOIN asked USING (term) JOIN terms USING (term), stats GROUP BY ALL)"""
#: Documents as chunks with vectors: that of the id by the number of vectors.
SEEN = "seen AS (SELECT doc_id AS id, coalesce(source, '') AS source, coalesce(text, '') AS text, CAST(embedding AS DOUBLE[]) AS vec, CAST([] AS VARCHAR[]) AS tags FROM documents JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings))"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"


def fused(ok: str, scored: str = "scored", k: int = C.TOP_K) -> str:
    return f"""ranks AS (SELECT qid, id, ok, CASE WHEN cos IS NOT NULL THEN row_number() OVER (PARTITION BY qid ORDER BY cos DESC NULLS LAST, id) - 1 END AS rc,
    row_number() OVER (PARTITION BY qid ORDER BY ok DESC, bm DESC, id) - 1 AS rb FROM {scored}),
best AS (SELECT qid, id, round(coalesce(1.0 / ({C.RRF_K} + rc), 0.0) + 1.0 / ({C.RRF_K} + rb), 9) AS score, coalesce(rc, rb) AS tie FROM ranks WHERE {ok}),
found AS (SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, tie) AS INTEGER) AS rank FROM best QUALIFY rank <= {k})"""


HYBRID = f"""{SEEN}, {IDF}, {QUESTIONS}, {BM25},
vectors AS (SELECT qid, CAST(embedding AS DOUBLE[]) AS qv FROM questions JOIN embeddings ON vec_id = qid % (SELECT count(*) FROM embeddings)),
scored AS (SELECT qid, s.id, round({dot("vec", "qv")} / sqrt({dot("qv", "qv")}), 6) AS cos, coalesce(score, 0.0) AS bm, true AS ok FROM seen s CROSS JOIN vectors LEFT JOIN bm USING (qid, id)), {fused("true")}"""
_STOP = ", ".join(map(q, T.STOP_WORDS))
def _bare(col: str) -> str:
    rx = "^[./'-]+|[./'-]+$"
    return f"list_transform(regexp_extract_all(lower({col}), {q(T.EVAL_TOKEN)}), lambda t: regexp_replace(t, {q(rx)}, '', 'g'))"


GOLD_TERMS = f"""bare AS (SELECT qid, {_bare("answer")} AS g FROM questions),
gold AS (SELECT qid, list_filter(list_transform(range(1, len(g) + 1), lambda i: CASE WHEN list_position(g, g[i]) = i AND g[i] <> '' AND ({has("g[i]", chr(92) + "p{Nd}")} OR (length(g[i]) >= {C.MIN_TERM} AND g[i] NOT IN ({_STOP}))) THEN g[i] END), lambda t: t IS NOT NULL)[:{C.MAX_TERMS}] AS terms FROM bare)"""
COVERAGE = f"""{HYBRID}, {GOLD_TERMS},
weighted AS (SELECT qid, term, CASE WHEN w = 0 THEN 1.0 ELSE w END AS w FROM (SELECT qid, term, least(coalesce(idf, {C.UNKNOWN_IDF}), {C.MAX_IDF}) AS w FROM (SELECT qid, unnest(terms) AS term FROM gold) LEFT JOIN terms USING (term))),
reached AS (SELECT w.qid, w.term, w.w, min(CASE WHEN contains(lower(s.text), w.term) THEN f.rank END) AS reach FROM weighted w LEFT JOIN found f USING (qid) LEFT JOIN seen s ON s.id = f.id GROUP BY ALL),
results AS (SELECT qid, round(coalesce(got / nullif(total, 0), 0.0), 4) AS coverage, coalesce(got / nullif(total, 0), 0.0) >= {C.HIT_COVERAGE} AS hit, first_rank, terms FROM
  (SELECT q.qid, coalesce(sum(CASE WHEN reach IS NOT NULL THEN w ELSE 0 END), 0.0) AS got, coalesce(sum(w), 0.0) AS total, CAST(coalesce(min(reach), 0) AS BIGINT) AS first_rank, count(term) AS terms FROM questions q LEFT JOIN reached r USING (qid) GROUP BY q.qid)),
sheets AS (SELECT sheet, count(*) AS n, CAST(sum(CAST(hit AS BIGINT)) AS BIGINT) AS hits, round(sum(CAST(hit AS BIGINT)) / count(*), 4) AS recall, round(avg(coverage), 4) AS coverage, round(avg(CASE WHEN first_rank > 0 THEN 1.0 / first_rank ELSE 0 END), 4) AS mrr FROM results JOIN questions USING (qid) GROUP BY sheet)"""


def placed(rank: int, rx: str, check: str) -> str:
    """The spans of one rule, from the lengths of pieces and matches."""
    return f"""SELECT doc_id, {rank} AS rank, length(array_to_string(p[:i], '')) + length(array_to_string(m[:i - 1], '')) AS start, m[i] AS match FROM
  (SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, {q(rx)}) AS m, regexp_split_to_array(text, {q(rx)}) AS p FROM numbered)) WHERE {check.replace("$", "m[i]")}"""


_DIGITS = "list_transform(string_split(regexp_replace($, '[^0-9]', '', 'g'), ''), lambda d: TRY_CAST(d AS BIGINT))"
_EAN = f"(length(regexp_replace($, '[^0-9]', '', 'g')) = 13 AND (10 - (list_sum({_DIGITS}[1:12:2]) + 3 * list_sum({_DIGITS}[2:12:2])) % 10) % 10 = ({_DIGITS})[13])"
_BARE = "upper(regexp_replace($, '[^A-Za-z0-9]', '', 'g'))"
_IBAN = f"""(length({_BARE}) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split({_BARE}[5:] || {_BARE}[:4], ''), lambda c: CAST(CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END AS BIGINT)), lambda a, v: CASE WHEN v > 9 THEN a * 100 + v ELSE a * 10 + v END % 97, CAST(0 AS BIGINT)) = 1)"""
_PART = lambda i: f"TRY_CAST(regexp_replace(regexp_split_to_array({strip('$')}, {q(f'[{S},/]+')})[{i}], '[^0-9.]', '', 'g') AS DOUBLE)"
CHECK_SQL = {
    None: "true",
    "ean13": _EAN,
    "iban": _IBAN,
    "lv95": f"coalesce({_PART(1)} BETWEEN 2480000 AND 2840000 AND {_PART(-1)} BETWEEN 1070000 AND 1300000, false)",
    "lv03": f"coalesce({_PART(1)} BETWEEN 480000 AND 840000 AND {_PART(-1)} BETWEEN 70000 AND 300000, false)",
}
NUMBERED_DUCK = NUMBERED.replace("{g}", ", 'g'")
RAW_SPANS = f"numbered AS ({NUMBERED_DUCK}), raw AS ({' UNION ALL '.join(placed(i, r.pattern, CHECK_SQL[r.check]) for i, r in enumerate(PATTERNS) if r.active)})"
_NAMES = "[" + ", ".join(q(r.name) for r in PATTERNS) + "]"
_REPLACEMENTS = "[" + ", ".join(q(r.replacement) for r in PATTERNS) + "]"
SWEPT = f"""{RAW_SPANS}, ordered AS (SELECT *, start + length(match) AS fin, row_number() OVER (PARTITION BY doc_id ORDER BY start, length(match) DESC, rank) AS n FROM raw),
swept AS (SELECT doc_id, n, start, fin, rank, match, true AS take, fin AS last FROM ordered WHERE n = 1
  UNION ALL SELECT o.doc_id, o.n, o.start, o.fin, o.rank, o.match, o.start >= s.last, CASE WHEN o.start >= s.last THEN o.fin ELSE s.last END FROM swept s JOIN ordered o ON o.doc_id = s.doc_id AND o.n = s.n + 1),
kept AS (SELECT doc_id, start, fin, rank, match FROM swept WHERE take)"""

ORACLES: dict[str, str] = {
    "corpus_stats": "SELECT count(*) AS chunks, count(CASE WHEN doc_id % 3 <> 0 THEN 1 END) AS embedded, count(DISTINCT source) AS documents FROM documents",
    "documents_overview": "SELECT source, count(*) AS chunks, count(CASE WHEN doc_id % 3 <> 0 THEN 1 END) AS embedded FROM documents GROUP BY source",
    "distinct_sources": "SELECT DISTINCT source FROM documents",
    "exact_dedup": "SELECT doc_id, sha1(text) AS doc_hash, min(doc_id) OVER (PARTITION BY text) AS first_id, doc_id <> min(doc_id) OVER (PARTITION BY text) AS duplicate FROM documents",
    "unseen_content": "WITH n AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' neu' ELSE text END AS t FROM documents) SELECT doc_id, sha1(t) AS doc_hash FROM n WHERE t NOT IN (SELECT text FROM documents WHERE text IS NOT NULL)",
    "vector_upsert": f"""SELECT vec_id AS id, CASE WHEN vec_id % 4 = 0 THEN round(1.0 * (1 + vec_id % 5) / sqrt((1 + vec_id % 5) * (1 + vec_id % 5) + 4), 5) ELSE round(CAST(embedding[1] AS DOUBLE), 5) END AS first_value, CAST(CASE WHEN vec_id % 4 = 0 THEN 2 ELSE len(embedding) END AS INTEGER) AS size FROM embeddings""",
    "delete_source": "SELECT doc_id, source FROM documents WHERE source NOT IN ('src1', 'src2')",
    "clean_lines": f"SELECT doc_id, CAST(len(l) AS INTEGER) AS n, sha256(array_to_string(l, chr(10))) AS lines_sha256 FROM (SELECT doc_id, {LINES} AS l FROM ({STRUCTURED}))",
    "chunks": f"WITH RECURSIVE {CHUNKS} SELECT doc_id, CAST(ord AS INTEGER) AS ord, text FROM chunks",
    "chunk_tags": f"WITH RECURSIVE {CHUNKS} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM chunks) GROUP BY tag",
    "garbage_metrics": f"WITH RECURSIVE {CHUNKS}, m AS (SELECT doc_id, ord, {METRICS} FROM chunks) SELECT doc_id, CAST(ord AS INTEGER) AS ord, round(alpha, 6) AS alpha, round(density, 6) AS density, round(broken, 6) AS broken, {GARBAGE} AS garbage FROM m",
    "garbage_by_source": f"""WITH RECURSIVE {CHUNKS}, m AS (SELECT source, {METRICS} FROM chunks) SELECT source, count(*) AS n, CAST(sum(CAST({GARBAGE} AS BIGINT)) AS BIGINT) AS bad, round(sum(CAST({GARBAGE} AS BIGINT)) / count(*), 6) AS ratio,
  round(avg(alpha), 6) AS alpha_avg, round(avg(density), 6) AS density_avg, sum(CAST({GARBAGE} AS BIGINT)) / count(*) > {C.GARBAGE_DOC_MAX} AS doc_bad FROM m GROUP BY source""",
    "tokens": f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n, sha256(array_to_string(t, ' ')) AS tokens_sha256 FROM (SELECT doc_id, {toks('text')} AS t FROM documents)",
    "term_df_idf": f"WITH {IDF} SELECT term, df, round(idf, 6) AS idf FROM terms",
    "bm25_topk": f"WITH {IDF}, {QUESTIONS}, {BM25} SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS INTEGER) AS rank FROM bm QUALIFY rank < {C.TOP_K}",
    "cosine_topk": f"""WITH {SEEN}, {QUESTIONS}, vectors AS (SELECT qid, CAST(embedding AS DOUBLE[]) AS qv FROM questions JOIN embeddings ON vec_id = qid % (SELECT count(*) FROM embeddings)),
  c AS (SELECT qid, id, round({dot("vec", "qv")} / sqrt({dot("qv", "qv")}), 6) AS score FROM seen CROSS JOIN vectors)
  SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS INTEGER) AS rank FROM c QUALIFY rank < {C.TOP_K}""",
    "hybrid_topk": f"WITH {HYBRID} SELECT qid, id, score, rank FROM found",
    "gold_terms": f"WITH {QUESTIONS}, {GOLD_TERMS} SELECT qid, CAST(len(terms) AS INTEGER) AS n, array_to_string(terms, ' ') AS terms FROM gold",
    "coverage": f"WITH {COVERAGE} SELECT qid, coverage, hit, first_rank, terms FROM results",
    "eval_by_sheet": f"WITH {COVERAGE} SELECT sheet, n, hits, recall, coverage, mrr FROM sheets",
    "eval_overall": f"WITH {COVERAGE} SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(hits) AS BIGINT) AS hits, round(sum(hits) / sum(n), 4) AS recall, round(sum(coverage * n) / sum(n), 4) AS coverage, round(sum(mrr * n) / sum(n), 4) AS mrr FROM sheets",
    "eval_diff": f"""WITH {COVERAGE}, b AS (SELECT sheet, n, CAST(floor(hits / 2) AS BIGINT) AS hits, round(recall / 2, 4) AS recall, coverage, round(mrr / 2, 4) AS mrr FROM sheets WHERE sheet <> 'sheet3')
  SELECT a.sheet, a.n, b.recall AS recall_before, a.recall AS recall_after, round(a.recall - b.recall, 4) AS delta, b.mrr AS mrr_before, a.mrr AS mrr_after FROM sheets a JOIN b USING (sheet)""",
    "golden_recall": f"""WITH {IDF}, {QUESTIONS}, {BM25}, best AS (SELECT qid, id FROM bm QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 5),
  h AS (SELECT q.qid, max(CAST(coalesce(contains(lower(d.text), lower(string_split(q.answer, ' ')[3])), false) AS BIGINT)) AS hit FROM questions q LEFT JOIN best USING (qid) LEFT JOIN documents d ON d.doc_id = best.id GROUP BY q.qid)
  SELECT count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, round(sum(hit) / count(*), 4) AS recall FROM h""",
    "golden_set": f"""WITH {IDF}, {GOLDEN_SET}, {BM25}, best AS (SELECT qid, id FROM bm QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 5),
  h AS (SELECT q.qid, max(CAST(coalesce(contains(lower(d.text), lower(q.expected)), false) AS BIGINT)) AS hit FROM questions q LEFT JOIN best USING (qid) LEFT JOIN documents d ON d.doc_id = best.id GROUP BY q.qid)
  SELECT count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, round(sum(hit) / count(*), 4) AS recall FROM h""",
    "read_files": """WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^ -~]', '#', 'g') AS t FROM documents),
  made AS (SELECT doc_id, unnest(['txt', 'md', 'eml', 'pdf']) AS format, unnest([t, t, concat('## Mail von Max Muster', chr(10), 'From: Max Muster <m@x.example>', chr(10), 'Subject: Dokument ', CAST(doc_id AS STRING), chr(10), chr(10), trim(t)), CASE WHEN trim(t) = '' THEN '' ELSE t END]) AS text FROM t)
  SELECT doc_id, format, sha256(text) AS text_sha256 FROM made""",
    "checks_of_numbers": f"""WITH numbers AS (SELECT item_id AS id, s FROM benchmark, LATERAL (SELECT unnest([concat('756.9217.0', CAST(100 + item_id AS STRING), '.8', CAST(item_id % 10 AS STRING)), concat('CH93 0076 2011 6238 52', CAST(50 + item_id % 50 AS STRING), '7'), 'CH93 0076 2011 6238 5295 7', '756.9217.0769.85',
    concat(CAST(2400000 + item_id * 13337 % 500000 AS STRING), '.5 / ', CAST(1000000 + item_id * 7919 % 400000 AS STRING)), concat(CAST(400000 + item_id * 13337 % 500000 AS STRING), ', ', CAST(50000 + item_id * 7919 % 300000 AS STRING)), 'kein']) AS s))
  SELECT id, s, {CHECK_SQL["ean13"].replace("$", "s")} AS ean13, {CHECK_SQL["iban"].replace("$", "s")} AS iban, {CHECK_SQL["lv95"].replace("$", "s")} AS lv95, {CHECK_SQL["lv03"].replace("$", "s")} AS lv03 FROM numbers""",
    "pattern_hits": f"WITH {RAW_SPANS} SELECT {_NAMES}[rank + 1] AS rule, count(*) AS n, count(DISTINCT doc_id) AS docs FROM raw GROUP BY rank",
    "spans_resolved": f"WITH RECURSIVE {SWEPT} SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(fin AS INTEGER) AS \"end\", match AS text, {_NAMES}[rank + 1] AS rule, {_REPLACEMENTS}[rank + 1] AS replacement FROM kept",
    "redact": f"""WITH RECURSIVE {SWEPT}, gaps AS (SELECT doc_id, start, fin, {_REPLACEMENTS}[rank + 1] AS r, coalesce(lag(fin) OVER (PARTITION BY doc_id ORDER BY start), 0) AS pos FROM kept),
  pieces AS (SELECT doc_id, string_agg(n.text[pos + 1:start] || r, '' ORDER BY start) AS t, max(fin) AS last FROM gaps JOIN numbered n USING (doc_id) GROUP BY doc_id)
  SELECT doc_id, sha256(coalesce(t || n.text[last + 1:], n.text)) AS redacted_sha256 FROM numbered n LEFT JOIN pieces USING (doc_id)""",
    "windows": f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
  ends AS (SELECT doc_id, n, t, 0 AS idx, 0 AS pos, CASE WHEN n > {C.WINDOW_CHARS} THEN {C.WINDOW_CHARS} ELSE n END AS hard FROM d WHERE n > 0),
  w AS (SELECT doc_id, n, t, idx, pos, CASE WHEN hard < n AND cut > 0 THEN pos + {C.WINDOW_CHARS // 2} + cut ELSE hard END AS fin FROM ends, LATERAL (SELECT {C.WINDOW_CHARS // 2} - least(coalesce(nullif(instr(reverse(t[pos + {C.WINDOW_CHARS // 2} + 1:hard]), ' .'), 0) + 1, 100000), coalesce(nullif(instr(reverse(t[pos + {C.WINDOW_CHARS // 2} + 1:hard]), chr(10)), 0), 100000)) + 1 AS cut) c
    UNION ALL
    SELECT doc_id, n, t, idx + 1, nat, CASE WHEN nhard < n AND cut > 0 THEN nat + {C.WINDOW_CHARS // 2} + cut ELSE nhard END FROM w, LATERAL (SELECT greatest(fin - {C.WINDOW_OVERLAP}, pos + 1) AS nat) a, LATERAL (SELECT CASE WHEN nat + {C.WINDOW_CHARS} < n THEN nat + {C.WINDOW_CHARS} ELSE n END AS nhard) b,
      LATERAL (SELECT {C.WINDOW_CHARS // 2} - least(coalesce(nullif(instr(reverse(t[nat + {C.WINDOW_CHARS // 2} + 1:nhard]), ' .'), 0) + 1, 100000), coalesce(nullif(instr(reverse(t[nat + {C.WINDOW_CHARS // 2} + 1:nhard]), chr(10)), 0), 100000)) + 1 AS cut) c WHERE fin < n)
  SELECT doc_id, CAST(idx AS INTEGER) AS idx, CAST(pos AS INTEGER) AS start, sha256(t[pos + 1:fin]) AS text_sha256 FROM w""",
    "html_strip": "SELECT page_id, length(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS n, sha256(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS text_sha256 FROM pages",
    "history_tail": "SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS role, coalesce(text, '')[:400] AS content FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4",
    "context_budget": f"""WITH c AS (SELECT conv_id, list(struct_pack(source := CASE WHEN turn % 2 = 0 THEN concat('src', CAST(turn AS STRING)) ELSE '' END, content := coalesce(text, '')) ORDER BY turn)[:{C.CONTEXTS}] AS l FROM conversations GROUP BY conv_id),
  t AS (SELECT conv_id, l, list_sum(list_transform(l, lambda x: length(x.content))) AS total FROM c),
  s AS (SELECT conv_id, l, CASE WHEN total <= {C.PROMPT_BUDGET} THEN total ELSE greatest({C.LEAST_CONTEXT}, {C.PROMPT_BUDGET} // len(l)) END AS share FROM t)
  SELECT conv_id, array_to_string(list_transform(l, lambda x: '[' || CASE WHEN x.source = '' THEN 'DOK' ELSE x.source END || ']' || chr(10) || x.content[:share]), chr(10) || chr(10) || '---' || chr(10) || chr(10)) AS context FROM s""",
    "shard_chain": """WITH f AS (SELECT l_orderkey, l_linenumber + CASE WHEN l_partkey % 5 = 0 THEN 8 ELSE 0 END AS number, sum(l_quantity) AS size FROM lineitem GROUP BY ALL),
  g AS (SELECT *, number - row_number() OVER (PARTITION BY l_orderkey ORDER BY number) AS gap FROM f WHERE number BETWEEN 1 AND 63)
  SELECT l_orderkey, count(*) AS shards, sum(size) AS total, max(size) AS largest FROM g WHERE gap = 0 GROUP BY l_orderkey""",
    "decode_rate": """SELECT user_id, count(*) AS tokens, round((epoch_us(min(ts)) - epoch_us(min(date_trunc('day', ts)))) / 1e6, 2) AS ttft, round(count(*) / greatest(0.001, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 8) AS rate FROM events GROUP BY user_id HAVING count(*) > 1""",
    "choose_variant": """WITH v AS (SELECT p_brand, ['q4f16', 'q4', 'int8', 'fp16'][1 + p_partkey % 4] AS dtype, sum(p_size * 10000000) AS total, max(p_size * 10000000) AS largest FROM part GROUP BY ALL),
  f AS (SELECT *, list_position(['q4f16', 'q4', 'int8', 'fp16'], dtype) AS r FROM v WHERE total >= 104857600 AND total <= 60000000000 AND largest <= 480000000)
  SELECT p_brand, arg_min(dtype, r) AS dtype, CAST(arg_min(total, r) AS BIGINT) AS total FROM f GROUP BY p_brand""",
    "sender_label": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN concat('max ', CAST(c_custkey AS STRING)) WHEN 2 THEN c_name ELSE concat('nobody ', CAST(c_custkey AS STRING)) END AS label FROM customer",
    "front_matter": f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('Titel ', CAST(doc_id AS STRING)) ELSE '' END AS title, CASE WHEN doc_id % 3 = 0 THEN concat('src,tag', CAST(doc_id AS STRING)) ELSE '' END AS tags, sha256(CASE WHEN doc_id % 3 = 0 THEN concat('# Titel ', CAST(doc_id AS STRING), chr(10), text) ELSE text END) AS text_sha256 FROM documents",
    "glossary_term": "SELECT item_id, CASE item_id % 3 WHEN 0 THEN concat('Thema ', CAST(item_id AS STRING)) WHEN 1 THEN concat('Ding ', CAST(item_id AS STRING)) ELSE concat('Erkläre ', CAST(item_id AS STRING)) END AS term FROM benchmark",
    "label": f"SELECT c_custkey, regexp_replace(concat(c_name, ' / ', c_mktsegment, '?'), {q(f'[^{T.WORD}.-]')}, '_', 'g')[:60] AS label FROM customer",
    "flat_chunks": f"""WITH d AS (SELECT doc_id, {strip(f"regexp_replace({JOINED}, {q(f'[{S}]+')}, ' ', 'g')")} AS t FROM documents),
  w AS (SELECT doc_id, t, unnest(range(0, CAST(greatest(0, ceil((length(t) - 350) / 270.0)) AS BIGINT) + 1)) AS i FROM d WHERE t <> ''),
  p AS (SELECT doc_id, i, {strip("t[i * 270 + 1:i * 270 + 350]")} AS text FROM w)
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS ord, text FROM p WHERE length(text) >= 20""",
    "junk_count": f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN repeat('. 12 ', 20) || repeat('.', 30) ELSE coalesce(text, '') END AS text FROM documents)
  SELECT length(text) - length(replace(text, '.', '')) > 30 AND length(regexp_replace(text, {q(f'[.{chr(92)}p{{Nd}}{S}]')}, '', 'g')) < 40 AS junk, count(*) AS n FROM t GROUP BY ALL""",
    "embedding_text": f"SELECT doc_id, CASE WHEN {strip('text')} <> '' THEN 'query: ' || {strip('text')}[:400] END AS query_text, CAST(length({strip('text')}) + 9 AS INTEGER) AS passage_length FROM documents",
    "answer_cleanup": "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN concat('Antwort ', CAST(conv_id AS STRING), ' fett') WHEN 1 THEN concat('Titel', chr(10), 'Text ', CAST(conv_id AS STRING)) WHEN 2 THEN repeat('Lange Antwort. ', 8)[:119] ELSE 'Dazu enthalten die Dokumente keine Angabe.' END AS answer FROM conversations",
    "absorb": """WITH d AS (SELECT doc_id, text, string_split(replace(text, chr(10), ' '), ' ') AS w FROM documents),
  a AS (SELECT doc_id, text, list_filter([w[1], w[3], w[1]], lambda x: x IS NOT NULL) AS raw FROM d),
  t AS (SELECT doc_id, text, i, term FROM (SELECT doc_id, text, raw, unnest(range(1, len(raw) + 1)) AS i, unnest(raw) AS term FROM a) WHERE list_position(raw, term) = i AND length(term) BETWEEN 3 AND 60 AND regexp_matches(term, '^[A-Za-z]+$')),
  o AS (SELECT doc_id, i, term, p, j, length(array_to_string(p[:j], '')) + (j - 1) * length(term) AS start FROM (SELECT doc_id, i, term, p, unnest(range(1, len(p))) AS j FROM (SELECT doc_id, i, term, string_split(text, term) AS p FROM t))),
  first AS (SELECT doc_id, start, start + length(term) AS fin FROM o WHERE i = 1)
  SELECT doc_id, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts FROM o WHERE i = 1 OR NOT EXISTS (SELECT 1 FROM first f WHERE f.doc_id = o.doc_id AND o.start < f.fin AND o.start + length(o.term) > f.start) GROUP BY doc_id""",
    "ingest_status": """WITH old AS (SELECT concat('f', CAST(item_id AS STRING)) AS source, text FROM benchmark WHERE item_id % 2 = 0),
  new AS (SELECT concat('f', CAST(CASE WHEN item_id % 4 = 2 THEN item_id + 1000 ELSE item_id END AS STRING)) AS source, CASE WHEN item_id % 8 = 0 THEN concat(text, ' neu') WHEN item_id % 10 = 5 THEN ' ' ELSE text END AS text, CASE WHEN item_id % 10 = 7 THEN 'cannot be read' END AS error, item_id % 5 + 1 AS n FROM benchmark),
  same AS (SELECT text, min(source) AS same FROM old GROUP BY text), has AS (SELECT source, count(*) AS n_old FROM old GROUP BY source)
  SELECT new.source, CASE WHEN error IS NOT NULL THEN concat('error: ', error) WHEN trim(new.text) = '' THEN 'empty' WHEN same = new.source THEN 'unchanged' WHEN same IS NOT NULL THEN concat('duplicate of ', same) WHEN n_old IS NOT NULL THEN concat('OK, ', CAST(n AS STRING), ' chunks (version replaced, ', CAST(n_old AS STRING), ' old removed)') ELSE concat('OK, ', CAST(n AS STRING), ' chunks') END AS status
  FROM new LEFT JOIN same ON same.text = new.text LEFT JOIN has ON has.source = new.source""",
}
ORACLES |= {
    "store_insert": f"WITH RECURSIVE {CHUNKS}, n AS (SELECT concat(coalesce(source, ''), '/', CAST(doc_id AS STRING)) AS source, CAST(ord AS INTEGER) AS ord, sha1(text) AS doc_hash FROM chunks) SELECT row_number() OVER (ORDER BY source, ord) AS id, source, ord, doc_hash FROM n",
    "legacy_vectors": "SELECT vec_id, CASE WHEN vec_id % 7 <> 3 THEN CAST(len(embedding) AS INTEGER) ELSE CAST(-1 AS INTEGER) END AS size, CASE WHEN vec_id % 7 <> 3 THEN round(CAST(embedding[2] AS DOUBLE), 5) ELSE 0.0 END AS second_value FROM embeddings",
    "redact_proposed": f"SELECT doc_id, sha256(replace(replace(text, 'Pers-Nr', '[NAME]'), 'und CHE', '[NAME]')) AS redacted_sha256, CAST(len(string_split(text, 'Pers-Nr')) + len(string_split(text, 'und CHE')) - 2 AS INTEGER) AS n FROM ({NUMBERED_DUCK})",
    "redact_marked": "SELECT doc_id, sha256('ab  [X]  ' || coalesce(text, '')) AS redacted_sha256 FROM documents",
    "scan_report": f"WITH RECURSIVE {SWEPT}, h AS (SELECT doc_id, count(*) AS n FROM kept GROUP BY doc_id) SELECT doc_id, CAST(length(text) AS INTEGER) AS characters, CAST(coalesce(n, 0) AS INTEGER) AS n_hits, CAST({sum(r.active for r in PATTERNS)} AS INTEGER) AS rules_active FROM numbered LEFT JOIN h USING (doc_id)",
    "question_pick": "SELECT item_id AS qid, concat('sheet', CAST(item_id % 4 AS STRING)) AS sheet FROM benchmark WHERE item_id % 4 = 1",
    "top_sources": f"""WITH {IDF}, {QUESTIONS}, {BM25}, best AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bm QUALIFY rank <= 3)
  SELECT qid, arg_min(source, rank) AS top_source, string_agg(source, ',' ORDER BY rank) AS sources FROM best JOIN documents ON doc_id = id GROUP BY qid""",
    "writers": "SELECT p_partkey, concat('LM/', CAST(p_partkey AS STRING)) AS name FROM part WHERE p_partkey % 4 = 0",
}
#: Hard filters by SQL, for the queries of the same names.
FILTERS = {
    "filter_tags": "list_contains(tags, 'frist')",
    "filter_source": "contains(lower(source), 'src1')",
    "filter_glob": f"{has('lower(source)', '(?s)^src.*2$')}",
    "filter_phrase": "contains(lower(text), 'the th')",
    "filter_regex": "regexp_matches(text, '(?i)th[ae]n')",
    "filter_exclude": f"NOT (list_contains({toks('text')}, 'the') OR contains(lower(source), 'the'))",
    "filter_all": f"contains(lower(source), 'src') AND NOT (list_contains({toks('text')}, 'the') OR contains(lower(source), 'the')) AND regexp_matches(text, '(?i)[aeiou]s[.]')",
}
for _name, _test in FILTERS.items():
    ORACLES[_name] = f"WITH RECURSIVE {CHUNKS} SELECT doc_id, CAST(ord AS INTEGER) AS ord FROM chunks WHERE {_test}"
