"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

from .queries import FILLERS, GAP_MS, MIN_SPAN_MS

EVENTS = """
t AS (SELECT user_id AS file, event_id, event_type, epoch_us(ts) // 1000 AS "start", epoch_us(ts) // 1000 + CAST(round(coalesce(value, 0.0) * 60000) AS BIGINT) AS "end" FROM events),
e AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY "start", event_id) - 1 AS pos, event_type, "start", "end" FROM t)"""
SPANS = EVENTS + """,
sp AS (SELECT file, pos AS span_pos, event_type AS speaker, "start", "end" FROM e WHERE event_type IN ('view', 'purchase')),
ks AS (SELECT * FROM sp WHERE "end" - "start" >= %d)""" % MIN_SPAN_MS
WORDS = SPANS + """,
wo AS (SELECT file, pos AS word_pos, event_type AS word, "start", "end" FROM e WHERE event_type IN ('click', 'error', 'signup')),
pr AS (SELECT w.file, w.word_pos, s.speaker, s.span_pos, least(w."end", s."end") - greatest(w."start", s."start") AS ov,
              w."end" <= w."start" AND w."start" BETWEEN s."start" AND s."end" AS inside, greatest(s."start" - w."end", w."start" - s."end", 0) AS dist
       FROM wo w JOIN ks s ON w.file = s.file),
rk AS (SELECT file, word_pos, speaker, ov <= 0 AND NOT inside AS low,
              row_number() OVER (PARTITION BY file, word_pos ORDER BY CASE WHEN ov > 0 THEN 0 WHEN inside THEN 1 ELSE 2 END,
                                 CASE WHEN ov > 0 THEN -ov WHEN inside THEN 0 ELSE dist END, span_pos) AS r FROM pr),
asg AS (SELECT wo.*, rk.speaker, rk.low FROM wo JOIN rk ON wo.file = rk.file AND wo.word_pos = rk.word_pos AND rk.r = 1)"""


def turns(source: str) -> str:
    """CTEs that group the words of ``source`` into turns ``tu``."""
    return f"""
r1 AS (SELECT *, CASE WHEN speaker <> lag(speaker) OVER (PARTITION BY file ORDER BY word_pos) THEN 1 ELSE 0 END AS chg FROM {source}),
r2 AS (SELECT *, sum(chg) OVER (PARTITION BY file ORDER BY word_pos) AS run FROM r1),
r3 AS (SELECT *, max("end") OVER (PARTITION BY file, run ORDER BY word_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM r2),
r4 AS (SELECT *, CASE WHEN prev IS NULL OR "start" - prev > {GAP_MS} THEN 1 ELSE 0 END AS isnew FROM r3),
r5 AS (SELECT *, sum(isnew) OVER (PARTITION BY file ORDER BY word_pos) - 1 AS turn_pos FROM r4),
tu AS (SELECT file, CAST(turn_pos AS BIGINT) AS turn_pos, min(speaker) AS speaker, min_by("start", word_pos) AS "start", max("end") AS "end",
              string_agg(word, ' ' ORDER BY word_pos) AS text, count(*) AS n_words, count(*) FILTER (low) AS n_low FROM r5 GROUP BY file, turn_pos)"""


CONVERSATION = """
w0 AS (SELECT conv_id AS file, turn AS turn_pos, role AS speaker, regexp_extract_all(coalesce(text, ''), '\\S+') AS ws FROM conversations),
w1 AS (SELECT file, turn_pos, speaker, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w0),
w2 AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(word, '[.?!]["'')\\]]*$') THEN 1 ELSE 0 END) OVER (PARTITION BY file, turn_pos ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM w1),
sen AS (SELECT file, turn_pos, any_value(speaker) AS speaker, row_number() OVER (PARTITION BY file, turn_pos ORDER BY s) - 1 AS pos, list(word ORDER BY i) AS ws, min(i) AS first_i FROM w2 GROUP BY file, turn_pos, s),
ctx0 AS (SELECT conv_id AS file, turn AS turn_pos, role AS speaker, text, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS nw, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS lt FROM conversations),
ctx1 AS (SELECT *, sum(nw) OVER (PARTITION BY file ORDER BY turn_pos) AS run FROM ctx0),
ctx2 AS (SELECT file, turn_pos, regexp_extract_all(coalesce(first_value(lt) OVER (PARTITION BY file, run ORDER BY turn_pos), ''), '\\S+') AS cw FROM ctx1),
ctx AS (SELECT file, turn_pos, array_to_string(cw[greatest(1, len(cw) - 24):], ' ') AS context FROM ctx2)"""


def packed(target: int) -> str:
    """CTEs that pack sentences into pieces ``pk`` (``file, turn_pos, pos, ws, first_i``)."""
    return CONVERSATION + f""",
step AS (
  SELECT file, turn_pos, pos, ws, first_i, CAST(len(ws) AS BIGINT) AS n, CASE WHEN len(ws) > {target} THEN 0 ELSE len(ws) END AS filled, 0 AS grp, len(ws) > {target} AS cut
  FROM sen WHERE pos = 0
  UNION ALL
  SELECT s.file, s.turn_pos, s.pos, s.ws, s.first_i, len(s.ws),
         CASE WHEN len(s.ws) > {target} THEN 0 WHEN p.filled > 0 AND p.filled + len(s.ws) <= {target} THEN p.filled + len(s.ws) ELSE len(s.ws) END,
         CASE WHEN len(s.ws) <= {target} AND p.filled > 0 AND p.filled + len(s.ws) <= {target} THEN p.grp ELSE p.grp + 1 END, len(s.ws) > {target}
  FROM step p JOIN sen s ON s.file = p.file AND s.turn_pos = p.turn_pos AND s.pos = p.pos + 1),
wo AS (SELECT file, turn_pos, grp, cut, unnest(ws) AS word, unnest(range(first_i, first_i + len(ws))) AS i FROM step),
wg AS (SELECT *, CASE WHEN cut THEN (row_number() OVER (PARTITION BY file, turn_pos, grp ORDER BY i) - 1) // {target} ELSE 0 END AS part FROM wo),
pk AS (SELECT file, turn_pos, row_number() OVER (PARTITION BY file, turn_pos ORDER BY grp, part) - 1 AS pos, list(word ORDER BY i) AS ws, min(i) AS first_i, max(i) AS last_i FROM wg GROUP BY file, turn_pos, grp, part)"""


def merged(source: str, same: str) -> str:
    """CTEs that merge small elements ``(k, q, n, sp)`` of ``source``: element q of group k ends in result ``o``.

    State: results so far, tokens and speaker of the last, and of the waiting element.
    """
    fits_last = f"(p.outs > 0 AND {same.format('p.last_sp', 'x')} AND p.last_n + {{n}} + 25 <= 180)"
    joins = f"(p.wait_n IS NOT NULL AND {same.format('p.wait_sp', 'e.sp')} AND p.wait_n + e.n + 25 <= 180)"
    return f"""
st AS (
  SELECT k, q, CASE WHEN n < 20 THEN 0 ELSE 1 END AS outs, CASE WHEN n < 20 THEN 0 ELSE n END AS last_n, sp AS last_sp, CASE WHEN n < 20 THEN n END AS wait_n, sp AS wait_sp, 1 AS o FROM {source} WHERE q = 0
  UNION ALL
  SELECT k, q, outs2 + CASE WHEN m >= 20 THEN 1 ELSE 0 END,
         CASE WHEN m >= 20 THEN m WHEN back THEN last2 + m ELSE last2 END, CASE WHEN m >= 20 THEN sp2 ELSE lsp2 END,
         CASE WHEN m >= 20 OR back THEN NULL ELSE m END, sp2, CASE WHEN m >= 20 THEN outs2 + 1 WHEN back THEN outs2 ELSE outs2 + 1 END
  FROM (
    SELECT *, outs2 > 0 AND m < 20 AND {same.format('lsp2', 'sp2')} AND last2 + m + 25 <= 180 AS back
    FROM (
      SELECT e.k, e.q, CASE WHEN {joins} THEN p.wait_n + e.n ELSE e.n END AS m, e.sp AS sp2,
             CASE WHEN p.wait_n IS NOT NULL AND NOT {joins} THEN p.outs + 1 ELSE p.outs END AS outs2,
             CASE WHEN p.wait_n IS NOT NULL AND NOT {joins} THEN p.wait_n ELSE p.last_n END AS last2,
             CASE WHEN p.wait_n IS NOT NULL AND NOT {joins} THEN p.wait_sp ELSE p.last_sp END AS lsp2
      FROM st p JOIN {source} e ON e.k = p.k AND e.q = p.q + 1) y) z)"""


CHUNKS = (
    "WITH RECURSIVE "
    + packed(100)
    + """,
el AS (SELECT pk.file AS k, row_number() OVER (PARTITION BY pk.file ORDER BY pk.turn_pos, pk.pos) - 1 AS q, CAST(len(pk.ws) AS BIGINT) AS n, c.role AS sp, pk.turn_pos, pk.ws, pk.first_i, pk.last_i
       FROM pk JOIN conversations c ON c.conv_id = pk.file AND c.turn = pk.turn_pos),"""
    + merged("el", "{} = {}")
    + """,
ch AS (SELECT st.k AS file, st.o - 1 AS chunk_pos, min(el.sp) AS speaker, min_by(el.turn_pos, el.q) AS turn_pos, CAST(min_by(el.first_i - 1, el.q) * 500 AS BIGINT) AS start_ms,
              CAST(max((el.last_i - 1) * 500 + 400) AS BIGINT) AS end_ms, string_agg(array_to_string(el.ws, ' '), ' ' ORDER BY el.q) AS text, CAST(sum(el.n) AS BIGINT) AS n_words
       FROM st JOIN el ON st.k = el.k AND st.q = el.q GROUP BY st.k, st.o),
fin AS (SELECT ch.*, CASE WHEN ctx.context <> '' THEN ctx.context || ' ' || ch.text ELSE ch.text END AS embed_text FROM ch JOIN ctx ON ctx.file = ch.file AND ctx.turn_pos = ch.turn_pos)
"""
)

INDEX = """
ix0 AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '\\d+(?:\\.\\d+)?|\\p{L}+') AS ls FROM documents),
ix AS (SELECT id, unnest(ls) AS term, unnest(range(1, len(ls) + 1)) AS pos FROM ix0)"""
TERMS = """
b0 AS (SELECT item_id AS qid, regexp_extract_all(lower(text), '[a-z]{6,}') AS ls FROM benchmark),
b1 AS (SELECT qid, unnest(ls) AS term, unnest(range(1, len(ls) + 1)) AS p FROM b0),
b2 AS (SELECT qid, term, min(p) AS p FROM b1 GROUP BY qid, term),
b3 AS (SELECT qid, term, row_number() OVER (PARTITION BY qid ORDER BY p) - 1 AS i FROM b2),
q AS (SELECT qid, term, i, count(*) OVER (PARTITION BY qid) AS nt FROM b3 WHERE i < 2)"""
HAVE = INDEX + "," + TERMS + """,
h AS (SELECT DISTINCT q.qid, q.i, q.nt, ix.id FROM q JOIN ix ON q.term = ix.term),
mat AS (SELECT qid, id FROM h GROUP BY qid, id HAVING count(*) = min(nt))"""
KEYWORD = HAVE + """,
hit AS (SELECT q.qid, ix.id, q.term, ix.pos FROM q JOIN ix ON q.term = ix.term JOIN mat ON mat.qid = q.qid AND mat.id = ix.id),
lastp AS (SELECT a.qid, a.id, a.pos, t.term, max(b.pos) AS p FROM hit a JOIN q t ON t.qid = a.qid LEFT JOIN hit b ON b.qid = a.qid AND b.id = a.id AND b.term = t.term AND b.pos <= a.pos GROUP BY a.qid, a.id, a.pos, t.term),
st AS (SELECT qid, id, pos, min(p) AS s FROM lastp GROUP BY qid, id, pos HAVING count(*) = count(p)),
cov AS (SELECT qid, id, s, min(pos) AS e FROM st GROUP BY qid, id, s),
one AS (SELECT c.qid, c.id, c.s, 0.1 / (1 + c.e - c.s - (count(DISTINCT h.pos) - 1)) AS v FROM cov c JOIN hit h ON h.qid = c.qid AND h.id = c.id AND h.pos BETWEEN c.s AND c.e GROUP BY c.qid, c.id, c.s, c.e),
sc AS (SELECT qid, id, round(CAST(sum(v) AS DOUBLE), 6) AS score FROM one GROUP BY qid, id),
kw AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc)"""
VECTOR = """
ve AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
vs AS (SELECT a.id // 20 AS qid, b.id, list_cosine_similarity(b.v, a.v) AS score FROM ve a JOIN ve b ON a.id % 20 = 0 AND a.id <> b.id),
vc AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM vs)"""


def fused(k: int, keyword: str = KEYWORD, vector: str = VECTOR) -> str:
    return keyword + "," + vector + f""",
fu AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.id, b.id) AS id, a.rank AS kw_rank, b.rank AS vec_rank,
              coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS score
       FROM (SELECT * FROM kw WHERE rank <= 30) a FULL OUTER JOIN (SELECT * FROM vc WHERE rank <= 30) b ON a.qid = b.qid AND a.id = b.id),
fr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, least(coalesce(kw_rank, vec_rank), coalesce(vec_rank, kw_rank)), id) AS rank FROM fu),
hy AS (SELECT * FROM fr WHERE rank <= {k})"""


#: Scores that tie to the ninth digit; vectors of documents, for the numbers that search_moments asks.
MOMENTS = fused(
    5,
    KEYWORD.replace("round(CAST(sum(v) AS DOUBLE), 6)", "round(CAST(sum(v) AS DOUBLE), 9)").replace("FROM b3 WHERE i < 2)", "FROM b3 WHERE i < 2 AND qid % 4 < 3 AND qid * 20 IN (SELECT vec_id FROM embeddings))"),
    VECTOR.replace(" AND a.id <> b.id", " AND a.id // 20 IN (SELECT qid FROM q) AND b.id IN (SELECT doc_id FROM documents)"),
)
PHRASE = """p AS (SELECT item_id AS qid, regexp_extract_all(lower(text), '\\d+(?:\\.\\d+)?|\\p{L}+') AS ls FROM benchmark),
a AS (SELECT qid, ls[1] AS t1, ls[2] AS t2 FROM p)"""

EVAL = "WITH " + fused(10) + """,
mo AS (SELECT qid, mode, rank, id % 7 AS file, id % 50 * 1000 AS start_ms, id % 50 * 1000 + 10000 AS end_ms FROM (
  SELECT qid, 'keyword' AS mode, rank, id FROM kw WHERE rank <= 10 UNION ALL SELECT qid, 'vector', rank, id FROM vc WHERE rank <= 10 UNION ALL SELECT qid, 'hybrid', rank, id FROM hy) x),
lq AS (SELECT item_id AS qid, CASE item_id % 3 WHEN 0 THEN 'lexical' WHEN 1 THEN 'semantic' ELSE 'mixed' END AS type FROM benchmark),
ls AS (SELECT qid, span_id, (qid + span_id) % 7 AS file, (qid * 7 + span_id * 11) % 55 AS s FROM (SELECT item_id AS qid, unnest(range(0, item_id % 4 + 1)) AS span_id FROM benchmark) x),
sh AS (SELECT mo.qid, mo.mode, mo.rank, ls.span_id FROM mo JOIN ls ON mo.qid = ls.qid AND mo.file = ls.file AND mo.start_ms < (ls.s + 3) * 1000 AND mo.end_ms > ls.s * 1000),
md AS (SELECT unnest(['keyword', 'vector', 'hybrid']) AS mode),
ag AS (SELECT lq.qid, lq.type, md.mode,
        (SELECT count(DISTINCT span_id) FROM sh WHERE sh.qid = lq.qid AND sh.mode = md.mode AND sh.rank <= 5) AS n_hit,
        (SELECT count(*) FROM ls WHERE ls.qid = lq.qid) AS n_spans,
        (SELECT min(rank) FROM sh WHERE sh.qid = lq.qid AND sh.mode = md.mode) AS first_rank,
        (SELECT count(*) FROM mo WHERE mo.qid = lq.qid AND mo.mode = md.mode) AS n_results
       FROM lq, md),
ev AS (SELECT qid, type, mode, n_hit::DOUBLE / n_spans AS recall, coalesce(1.0::DOUBLE / first_rank, 0) AS rr, first_rank, n_results FROM ag),
ty AS (SELECT unnest(['lexical', 'semantic', 'mixed', 'all']) AS type),
su AS (SELECT ty.type, md.mode, count(ev.qid) AS n, coalesce(avg(ev.recall), 0) AS recall, coalesce(avg(ev.rr), 0) AS mrr
       FROM ty CROSS JOIN md LEFT JOIN ev ON ev.mode = md.mode AND (ev.type = ty.type OR ty.type = 'all') GROUP BY ty.type, md.mode),
pv AS (SELECT type, max(CASE WHEN mode = 'keyword' THEN recall END) AS k, max(CASE WHEN mode = 'vector' THEN recall END) AS v, max(CASE WHEN mode = 'hybrid' THEN recall END) AS h FROM su WHERE type <> 'all' GROUP BY type)
"""

SPOKEN = EVENTS + """,
so AS (SELECT file, pos AS word_pos, event_type || '.' || (pos % 7) AS word, "start", "end", event_type AS speaker, pos % 5 = 0 AS low FROM e)"""
TURN_COLUMNS = 'SELECT file, turn_pos, speaker, "start", "end", text, n_words, n_low FROM tu'

DF = """
tf AS (SELECT term, id, count(*) AS tf FROM ix GROUP BY term, id),
dl AS (SELECT id, len(ls) AS dl FROM ix0),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""


def bm25(asked: str) -> str:
    """CTEs that rank all documents by BM25 for the terms ``asked`` (``qid, term, weight``)."""
    return f"""{asked},
av AS (SELECT count(*) AS n, avg(dl) AS a FROM dl),
bs AS (SELECT w.qid, tf.id, round(CAST(sum(w.weight * ln(1 + (av.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)) * (tf.tf * 2.2::DOUBLE / (tf.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl.dl / av.a)))) AS DOUBLE), 6) AS score
       FROM wa w JOIN tf ON tf.term = w.term JOIN df ON df.term = w.term JOIN dl ON dl.id = tf.id, av GROUP BY w.qid, tf.id),
br AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bs)"""


#: DuckDB counts edits of bytes, so letters of two bytes become capitals, which lower-case words lack.
ASCII = "translate({}, 'ßäçèéêíñóöüàâîïôûùœæáúëø', 'ABCDEFGHIJKLMNOPQRSTUVWX')"
FUZZY = "WITH " + INDEX + "," + TERMS + "," + DF + """,
ms AS (SELECT DISTINCT qid, substr(term, 1, 2) || substr(term, 4) AS term FROM q),
vo AS (SELECT term, df, """ + ASCII.format("term") + """ AS a FROM df),
fz AS (SELECT m.term, vo.term AS match, levenshtein(m.a, vo.a) AS distance, vo.df FROM (SELECT DISTINCT term, """ + ASCII.format("term") + """ AS a FROM ms) m JOIN vo ON abs(length(m.term) - length(vo.term)) <= 2 AND levenshtein(m.a, vo.a) <= CASE WHEN length(m.term) < 3 THEN 0 WHEN length(m.term) < 6 THEN 1 ELSE 2 END)"""


def oracle_sql() -> dict[str, str]:
    fillers = ", ".join(f"'{w}'" for w in FILLERS)
    return {
        "scan_conversation_stats": "SELECT conv_id, count(*) AS n_turns, count(DISTINCT role) AS n_roles, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id",
        "token_counts": "SELECT doc_id AS id, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS n_tokens, CAST(length(regexp_replace(text, '\\s', '', 'g')) AS BIGINT) AS n_chars FROM documents",
        "anti_join_pending": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
        "paired_inputs": "SELECT d.doc_id, d.source, CAST(l.quality AS BIGINT) AS quality, CAST(l.toxic AS BIGINT) AS toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
        "ingest_ids": "SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) AS id FROM documents",
        "ingest_by_file": "SELECT source AS file, count(*) AS n_chunks, CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS n_words FROM documents GROUP BY source",
        "ingest_health": "SELECT count(*) AS n_chunks, count(*) FILTER (v.vec_id IS NULL) AS n_no_vector, count(*) FILTER (NOT regexp_matches(lower(coalesce(d.text, '')), '\\d+(?:\\.\\d+)?|\\p{L}+')) AS n_no_terms FROM documents d LEFT JOIN embeddings v ON d.doc_id = v.vec_id",
        "segment_normalize": "WITH " + EVENTS + """ SELECT file, pos, event_type AS text, round("start" % 100000000 / 1000.0::DOUBLE, 3) AS "start", round("end" % 100000000 / 1000.0::DOUBLE, 3) AS "end",
            CAST(CASE WHEN pos % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_words, CASE WHEN pos % 2 = 0 THEN event_type END AS word, CASE WHEN pos % 2 = 0 THEN round("end" % 100000000 / 1000.0::DOUBLE, 3) END AS word_end FROM e""",
        "filter_spans": "WITH " + SPANS + ' SELECT file, span_pos, speaker, "start", "end" FROM ks',
        "exclusive_spans": "WITH " + SPANS + """, c AS (SELECT *, max("end") OVER (PARTITION BY file ORDER BY "start", span_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up FROM sp)
            SELECT file, span_pos, speaker, greatest("start", up) AS "start", "end" FROM c WHERE greatest("start", up) < "end" """,
        "voice_segments": "WITH " + EVENTS + """, l AS (SELECT file, pos, "end" - "start" AS v, pos - row_number() OVER (PARTITION BY file ORDER BY pos) AS r FROM e WHERE "end" - "start" >= 1200000),
            i AS (SELECT file, min(pos) AS a, max(pos) AS z FROM l GROUP BY file, r HAVING max(v) >= 6000000), j AS (SELECT *, CASE WHEN a - lag(z) OVER (PARTITION BY file ORDER BY a) <= 3 THEN 0 ELSE 1 END AS n FROM i),
            k AS (SELECT *, sum(n) OVER (PARTITION BY file ORDER BY a) AS g FROM j) SELECT file, min(a) AS first, max(z) AS last FROM k GROUP BY file, g""",
        "speaker_totals": "WITH " + SPANS + """, a AS (SELECT file, speaker, CAST(sum("end" - "start") AS BIGINT) AS total FROM sp GROUP BY file, speaker)
            SELECT file, speaker, total, round(CASE WHEN sum(total) OVER (PARTITION BY file) <> 0 THEN 100.0::DOUBLE * total / sum(total) OVER (PARTITION BY file) ELSE 0 END, 6) AS share FROM a""",
        "join_split_tokens": """WITH a AS (SELECT conv_id AS file, turn, regexp_extract_all(text, '\\p{L}+|[^\\s\\p{L}]') AS ls FROM conversations),
            b AS (SELECT file, turn, unnest(ls) AS word, unnest(range(0, len(ls))) AS p FROM a),
            c AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY turn, p) - 1 AS word_pos, word FROM b),
            g AS (SELECT *, sum(CASE WHEN word_pos = 0 OR substr(word, 1, 1) NOT IN ('-', '.', '%') THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY word_pos) AS grp FROM c)
            SELECT file, min(word_pos) AS word_pos, string_agg(word, '' ORDER BY word_pos) AS word, min(word_pos) * 500 AS "start", max(word_pos) * 500 + 400 AS "end" FROM g GROUP BY file, grp""",
        "assign_overlap": "WITH " + WORDS + " SELECT file, word_pos, speaker, low FROM asg",
        "group_turns": "WITH " + SPOKEN + "," + turns("so") + " " + TURN_COLUMNS,
        "align_end_to_end": "WITH " + WORDS + "," + turns("asg") + " " + TURN_COLUMNS,
        "align_invariants": "WITH " + SPOKEN + " SELECT file, CAST(sum(length(word)) AS BIGINT) AS chars_in, CAST(sum(length(word)) AS BIGINT) AS chars_out, count(*) AS tokens_in, count(*) AS tokens_out, true AS ok FROM so GROUP BY file",
        "align_report": "WITH " + WORDS + "," + turns("asg") + """, a AS (SELECT file, count(*) AS n_turns, CAST(sum(n_words) AS BIGINT) AS n_words, CAST(sum(n_low) AS BIGINT) AS n_low FROM tu GROUP BY file),
            b AS (SELECT file, count(*) AS n_spans, count(*) FILTER ("end" - "start" < %d) AS n_dropped FROM sp GROUP BY file)
            SELECT a.file, n_turns, n_words, n_low, n_spans, n_dropped, round(100.0::DOUBLE * n_low / n_words, 6) AS low_pct FROM a JOIN b ON a.file = b.file""" % MIN_SPAN_MS,
        "low_turns": "WITH " + WORDS + "," + turns("asg") + """, a AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY turn_pos) AS rank FROM tu WHERE n_low > 0)
            SELECT file, turn_pos, rank, n_low, substr(text, 1, 80) AS snippet FROM a WHERE rank <= 15""",
        "backchannel": f"""WITH a AS (SELECT conv_id, turn, string_split(text, '.') AS ls FROM conversations), b AS (SELECT conv_id, turn, unnest(ls) AS s, unnest(range(0, len(ls))) AS part FROM a),
            c AS (SELECT conv_id, turn, part, list_filter(list_transform(regexp_extract_all(s, '\\S+'), lambda x: regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}_-]', '', 'g')), lambda x: x <> '') AS t FROM b)
            SELECT conv_id, turn, part, len(t) > 0 AND len(list_filter(t, lambda x: x NOT IN ({fillers}))) = 0 AS is_backchannel FROM c""",
        "split_sentences": "WITH " + CONVERSATION + " SELECT file, turn_pos, pos, array_to_string(ws, ' ') AS sentence FROM sen",
        "context_for": "WITH " + CONVERSATION + " SELECT file, turn_pos, context FROM ctx",
        "split_turn": "WITH RECURSIVE " + packed(40) + " SELECT file, turn_pos, pos, CAST(len(ws) AS BIGINT) AS n_words, array_to_string(ws, ' ') AS text FROM pk",
        "merge_small": "WITH RECURSIVE el AS (SELECT source AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS q, CAST(n_chars // 40 AS BIGINT) AS n, 'a' AS sp, doc_id FROM documents)," + merged("el", "{} = {}") + """
            SELECT st.k AS source, st.o - 1 AS pos, CAST(sum(el.n) AS BIGINT) AS n, string_agg(CAST(doc_id AS VARCHAR), ' ' ORDER BY el.q) AS ids FROM st JOIN el ON st.k = el.k AND st.q = el.q GROUP BY st.k, st.o""",
        "chunk_output": CHUNKS + " SELECT file, CAST(chunk_pos AS BIGINT) AS chunk_pos, speaker, start_ms, end_ms, text, n_words, embed_text FROM fin",
        "chunk_size_report": CHUNKS + """ SELECT file, count(*) AS n_chunks, min(n_words) AS min_words, list_sort(list(n_words))[count(*) // 2 + 1] AS median_words, max(n_words) AS max_words,
            count(*) FILTER (n_words < 20) AS n_small, CAST(max(len(regexp_extract_all(embed_text, '\\S+'))) AS BIGINT) AS max_embed_words FROM fin GROUP BY file""",
        "postings": "WITH " + INDEX + " SELECT term, count(*) AS n, count(DISTINCT id) AS n_docs, CAST(sum(pos) AS BIGINT) AS sum_pos FROM ix GROUP BY term",
        "keyword_and": "WITH " + HAVE + " SELECT qid, id FROM mat",
        "keyword_or": "WITH " + HAVE + " SELECT DISTINCT qid, id FROM h",
        "keyword_not": "WITH " + HAVE + " SELECT qid, id FROM h WHERE i = 0 AND NOT EXISTS (SELECT 1 FROM h g WHERE g.qid = h.qid AND g.id = h.id AND g.i = 1)",
        "keyword_phrase": "WITH " + INDEX + """, p AS (SELECT item_id AS qid, regexp_extract_all(lower(text), '\\d+(?:\\.\\d+)?|\\p{L}+') AS ls FROM benchmark),
            a AS (SELECT qid, ls[1] AS t1, ls[2] AS t2 FROM p)
            SELECT DISTINCT a.qid, x.id FROM a JOIN ix x ON x.term = a.t1 JOIN ix y ON y.id = x.id AND y.pos = x.pos + 1 AND y.term = a.t2 WHERE a.t2 IS NOT NULL
            UNION SELECT a.qid, x.id FROM a JOIN ix x ON x.term = a.t1 WHERE a.t2 IS NULL""",
        "keyword_rank": "WITH " + KEYWORD + " SELECT qid, id, score, rank FROM kw WHERE rank <= 10",
        "vector_topk": "WITH " + VECTOR + " SELECT qid, id, round(score, 6) AS score, rank FROM vc WHERE rank <= 10",
        "bm25_rank": "WITH " + INDEX + "," + TERMS + "," + DF + "," + bm25("wa AS (SELECT qid, term, 1.0::DOUBLE AS weight FROM q)") + " SELECT qid, id, score, rank FROM br WHERE rank <= 10",
        "fuzzy_terms": FUZZY + " SELECT term, match, distance, df AS n_docs FROM fz",
        "fuzzy_rank": FUZZY + "," + bm25("wa AS (SELECT ms.qid, fz.match AS term, power(0.5::DOUBLE, min(fz.distance)) AS weight FROM ms JOIN fz ON fz.term = ms.term GROUP BY ms.qid, fz.match)") + " SELECT qid, id, score, rank FROM br WHERE rank <= 10",
        "vector_cells_all": "WITH " + VECTOR + " SELECT qid, id, round(score, 6) AS score, rank FROM vc WHERE rank <= 10",
        "store_upsert": """WITH a AS (SELECT row_number() OVER (ORDER BY source, doc_id) AS id, doc_id, source AS file, coalesce(text, '') AS text FROM documents),
            o AS (SELECT file FROM (SELECT file, row_number() OVER (ORDER BY file) AS r FROM (SELECT DISTINCT source AS file FROM documents) x) y WHERE r % 2 = 1),
            b AS (SELECT a.id, a.file, a.doc_id, a.text || CASE WHEN o.file IS NOT NULL AND a.doc_id IN (SELECT doc_id FROM labels) THEN ' revised' ELSE '' END AS text, o.file IS NOT NULL AS touched FROM a LEFT JOIN o ON a.file = o.file),
            c AS (SELECT id, file, doc_id AS start_ms, text FROM b WHERE NOT touched OR length(text) >= 200
                  UNION ALL SELECT (SELECT count(*) FROM documents) + row_number() OVER (ORDER BY item_id), 'benchmark', item_id, text FROM benchmark)
            SELECT id, file, start_ms, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS n_words, CAST(len(regexp_extract_all(lower(text), '\\d+(?:\\.\\d+)?|\\p{L}+')) AS BIGINT) AS n_terms, md5(text) AS md5 FROM c""",
        "rrf_fuse": "WITH " + fused(10) + " SELECT qid, id, round(score, 9) AS score, kw_rank, vec_rank, rank FROM hy",
        "hybrid_search": "WITH " + fused(5) + """ SELECT hy.qid, hy.rank, hy.id, d.source, substr(d.text, 1, 140) AS snippet, round(hy.score, 9) AS score,
            coalesce(CAST(kw_rank AS VARCHAR), '-') AS kw_rank, coalesce(CAST(vec_rank AS VARCHAR), '-') AS vec_rank FROM hy JOIN documents d ON d.doc_id = hy.id""",
        "search_forms": "WITH " + HAVE + ", " + PHRASE + """ SELECT qid, id FROM mat WHERE qid % 4 = 0 UNION SELECT qid, id FROM h WHERE qid % 4 = 1
            UNION SELECT qid, id FROM h WHERE qid % 4 = 2 AND i = 0 AND NOT EXISTS (SELECT 1 FROM h g WHERE g.qid = h.qid AND g.id = h.id AND g.i = 1)
            UNION SELECT a.qid, x.id FROM a JOIN ix x ON x.term = a.t1 JOIN ix y ON y.id = x.id AND y.pos = x.pos + 1 AND y.term = a.t2 WHERE a.qid % 4 = 3 AND a.qid IN (SELECT qid FROM q)
            UNION SELECT a.qid, x.id FROM a JOIN ix x ON x.term = a.t1 WHERE a.t2 IS NULL AND a.qid % 4 = 3 AND a.qid IN (SELECT qid FROM q)""",
        "search_moments": "WITH " + MOMENTS + """ SELECT hy.qid, hy.rank, hy.id, d.source AS file, d.lang AS speaker, d.doc_id * 1000 AS start_ms, d.doc_id * 1000 + 900 AS end_ms, substr(d.text, 1, 140) AS snippet,
            round(hy.score, 9) AS score, kw_rank, vec_rank FROM hy JOIN documents d ON d.doc_id = hy.id""",
        "format_moment": "WITH " + EVENTS + """, m AS (SELECT *, "start" % 10000000 // 1000 AS s FROM e)
            SELECT file, pos, CASE WHEN s // 60 < 100 THEN lpad(CAST(s // 60 AS VARCHAR), 2, '0') ELSE CAST(s // 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS at,
            CASE WHEN pos % 3 > 0 THEN CAST(pos AS VARCHAR) ELSE '-' END AS rank, substr(event_type, 1, 3) AS snippet FROM m""",
        "span_hits": EVAL + " SELECT qid, mode, rank, span_id FROM sh",
        "span_recall": EVAL + " SELECT qid, mode, round(recall, 6) AS recall FROM ev",
        "mrr": EVAL + " SELECT qid, mode, round(rr, 6) AS rr, first_rank FROM ev",
        "eval_rows": EVAL + " SELECT qid, type, mode, round(recall, 6) AS recall, round(rr, 6) AS rr, first_rank, n_results FROM ev",
        "summarize": EVAL + " SELECT type, mode, n, round(recall, 6) AS recall, round(mrr, 6) AS mrr FROM su",
        "zero_result_rate": EVAL + " SELECT count(*) FILTER (n_results = 0) AS n_empty, count(*) AS n_queries FROM ev WHERE mode = 'keyword'",
        "criteria": EVAL + """ SELECT type || ' R@5 (hybrid)' AS name, CASE type WHEN 'lexical' THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END AS target, round(h, 6) AS actual, h >= CASE type WHEN 'lexical' THEN 0.8 ELSE 0.7 END AS ok FROM pv WHERE type <> 'mixed'
            UNION ALL SELECT type || ' R@5: hybrid >= best single arm', round(greatest(k, v), 6), round(h, 6), h >= greatest(k, v) FROM pv""",
        "failure_status": EVAL + " SELECT qid, CASE WHEN recall = 0 THEN 'still fails' WHEN recall < 1 THEN 'partial' ELSE 'now passes' END AS status FROM ev WHERE mode = 'hybrid'",
        "per_query_pivot": EVAL + """ SELECT qid, type, round(max(CASE WHEN mode = 'keyword' THEN recall END), 6) AS keyword_recall, round(max(CASE WHEN mode = 'vector' THEN recall END), 6) AS vector_recall,
            round(max(CASE WHEN mode = 'hybrid' THEN recall END), 6) AS hybrid_recall, max(CASE WHEN mode = 'keyword' THEN first_rank END) AS keyword_rank,
            max(CASE WHEN mode = 'vector' THEN first_rank END) AS vector_rank, max(CASE WHEN mode = 'hybrid' THEN first_rank END) AS hybrid_rank FROM ev GROUP BY qid, type""",
    }
