"""SQL text of the bindings, used to state each query a second time for the correctness check."""

from __future__ import annotations


def ident(value: str) -> str:
    return f"'SRC_' || upper(substr(sha256(CAST({value} AS VARCHAR)), 1, 12))"


EV = f"""ev AS (
  SELECT event_id, event_type, value, props, {ident('user_id')} AS source_id,
         sha256(CAST(user_id AS VARCHAR)) AS content_sha256,
         (epoch_us(ts) - 1704067200000000) // 1000 AS ms
  FROM events),
src AS (SELECT source_id, content_sha256, max(ms) + 3600000 AS duration_ms FROM ev GROUP BY 1, 2)"""

OBS = f"""{EV},
obs0 AS (
  SELECT *, CASE event_type WHEN 'view' THEN 'visual' WHEN 'error' THEN 'acoustic' WHEN 'click' THEN 'ocr'
              WHEN 'signup' THEN 'speaker' ELSE 'asr' END AS adapter,
         CASE event_type WHEN 'view' THEN 'VID' WHEN 'error' THEN 'AUD' WHEN 'click' THEN 'OCR'
              WHEN 'signup' THEN 'ENTITY' ELSE 'ASR' END AS modality,
         CASE event_type WHEN 'view' THEN 'visual_state' WHEN 'error' THEN 'acoustic_event'
              WHEN 'click' THEN 'on_screen_text' WHEN 'signup' THEN 'speaker_presence' ELSE 'speech' END AS claim_type,
         ms // 21600000 * 21600000 AS start_ms FROM ev),
obs AS (
  SELECT source_id, printf('OBS_%06d', event_id) AS observation_id, adapter, start_ms,
         start_ms + 1800000 * (1 + event_id % 2) AS end_ms, claim_type,
         event_type || ' ' || props AS text, (event_id % 101) / 100.0::DOUBLE AS confidence, modality,
         CASE WHEN modality IN ('ASR', 'ENTITY') THEN 'SPK_' || (event_id % 7) END AS speaker_id,
         CASE WHEN modality = 'ASR' THEN 'amount ' || (event_id % 1000) END AS speech_text,
         CASE WHEN modality = 'ASR' AND event_id % 3 = 0 THEN 'asr' END AS speech_source,
         list_position(['visual', 'acoustic', 'ocr', 'speaker', 'asr'], adapter) AS rk
  FROM obs0),
refs AS (
  SELECT *, CASE WHEN modality IN ('VID', 'AUD')
                 THEN modality || ':' || source_id || ':ms:' || start_ms || '-' || end_ms
                 ELSE modality || ':' || observation_id END AS evidence_ref FROM obs),
claims AS (
  SELECT *, dense_rank() OVER (PARTITION BY source_id ORDER BY start_ms, end_ms) AS event_no,
         row_number() OVER (PARTITION BY source_id ORDER BY start_ms, end_ms, observation_id, rk) AS claim_no
  FROM refs),
evid AS (
  SELECT source_id, evidence_ref, observation_id, modality, start_ms, end_ms FROM refs
  QUALIFY row_number() OVER (PARTITION BY source_id, evidence_ref
                             ORDER BY start_ms DESC, end_ms DESC, observation_id DESC, rk DESC) = 1)"""


def chunks_of(start: str, end: str, duration: str, size: int = 86_400_000, overlap: int = 3_600_000) -> str:
    """Chunk list of an interval, found by testing every chunk of the source."""
    step = size - overlap
    return (
        f"list_transform(list_filter(range(0, CASE WHEN {duration} <= {size} THEN 1 ELSE "
        f"CAST(ceil(({duration} - {size}) / {step}.0) AS BIGINT) + 1 END), "
        f"lambda k: k * {step} < {end} AND least(k * {step} + {size}, {duration}) > {start}), "
        f"lambda k: printf('CHK_%04d', k + 1))"
    )


EVENTS = f"""{OBS},
ledger0 AS (
  SELECT c.source_id, event_no, c.start_ms, c.end_ms, any_value(duration_ms) AS duration_ms,
         count(*) AS claims, count(speech_text) AS speech_rows
  FROM claims c JOIN src USING (source_id) GROUP BY 1, 2, 3, 4),
ledger AS (
  SELECT source_id, event_no, printf('EVT_%06d', event_no) AS event_id, start_ms, end_ms,
         CASE WHEN start_ms * 2 < duration_ms THEN 'SCN_0001' ELSE 'SCN_0002' END AS scene_id,
         {chunks_of('start_ms', 'end_ms', 'duration_ms')} AS chunk_ids, claims, speech_rows, duration_ms
  FROM ledger0)"""

SPEECH = f"""{OBS},
speech AS (
  SELECT source_id, event_no, claim_no, start_ms, end_ms,
         coalesce(nullif(speaker_id, ''), 'SPEAKER_UNKNOWN') AS speaker_id, speech_text AS text,
         coalesce(nullif(speech_source, ''), 'sidecar_asr') AS source, evidence_ref, confidence
  FROM claims WHERE speech_text IS NOT NULL)"""

# Shots of a source: candidates at least 6 h apart, gaps over 2 days filled.
_EVENT_CANDIDATES = """cand AS (
  SELECT source_id, ms AS boundary_ms,
         CASE WHEN event_type IN ('view', 'purchase') THEN 'hard_cut' ELSE 'gradual_transition' END AS boundary_type,
         (event_id % 101) / 100.0::DOUBLE AS confidence
  FROM ev)"""


def _shots(src: str, min_ms: int, max_ms: int) -> str:
    """Accepted boundaries and shots of the candidates ``cand``."""
    return f"""inside AS (
  SELECT cand.* FROM cand JOIN {src} USING (source_id) WHERE boundary_ms > 0 AND boundary_ms < duration_ms
  QUALIFY row_number() OVER (PARTITION BY source_id, boundary_ms ORDER BY boundary_type, confidence) = 1),
spots AS (SELECT source_id, 0::BIGINT AS boundary_ms FROM {src} UNION SELECT source_id, boundary_ms FROM inside),
jump AS (
  SELECT s.source_id, s.boundary_ms, min(i.boundary_ms) AS next_ms FROM spots s
  JOIN inside i ON i.source_id = s.source_id AND i.boundary_ms - s.boundary_ms >= {min_ms} GROUP BY 1, 2),
walk AS (
  SELECT source_id, 0::BIGINT AS boundary_ms FROM {src}
  UNION ALL SELECT j.source_id, j.next_ms FROM walk w JOIN jump j USING (source_id, boundary_ms)),
firm AS (
  SELECT source_id, boundary_ms, coalesce(boundary_type, 'source_start') AS boundary_type,
         coalesce(confidence, 1.0::DOUBLE) AS confidence
  FROM walk LEFT JOIN inside USING (source_id, boundary_ms)),
spaced AS (
  SELECT firm.*, duration_ms,
         coalesce(lead(boundary_ms) OVER (PARTITION BY source_id ORDER BY boundary_ms), duration_ms) AS next_ms
  FROM firm JOIN {src} USING (source_id)),
bounds AS (
  SELECT source_id, boundary_ms, boundary_type, confidence FROM spaced
  UNION ALL
  SELECT source_id, unnest(range(boundary_ms + {max_ms}, next_ms, {max_ms})), 'uncertain', 0.0::DOUBLE
  FROM spaced WHERE next_ms - boundary_ms > {max_ms}),
shots AS (
  SELECT source_id, row_number() OVER w AS shot_no, boundary_ms AS start_ms,
         coalesce(lead(boundary_ms) OVER w, duration_ms) AS end_ms, boundary_type,
         confidence AS boundary_confidence, duration_ms
  FROM bounds JOIN {src} USING (source_id) WINDOW w AS (PARTITION BY source_id ORDER BY boundary_ms))"""


SHOTS = f"{EV},\n{_EVENT_CANDIDATES},\n{_shots('src', 21_600_000, 172_800_000)}"

FRAMES = f"""fr0 AS (
  SELECT {ident('label')} AS source_id, embedding,
         row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_index FROM embeddings),
fr AS (
  SELECT source_id, frame_index,
         list_transform(embedding, lambda x: CAST(floor(least(greatest((CAST(x AS DOUBLE) *
           CASE WHEN frame_index % 10 = 6 OR frame_index % 20 >= 17 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END
           + 0.5::DOUBLE) * 255, 0), 255)) AS INTEGER)) AS sig FROM fr0),
fsrc AS (SELECT source_id, count(*) * 100 AS duration_ms FROM fr GROUP BY 1),
diffs AS (
  SELECT b.source_id, b.frame_index, a.frame_index - b.frame_index AS ahead,
         list_sum(list_transform(list_zip(a.sig, b.sig), lambda z: abs(z[1] - z[2])))::DOUBLE / (len(a.sig) * 255.0::DOUBLE) AS d
  FROM fr a JOIN fr b ON a.source_id = b.source_id AND a.frame_index - b.frame_index BETWEEN 1 AND 4),
scored AS (
  SELECT fr.source_id, fr.frame_index, coalesce(d, 0.0::DOUBLE) AS score FROM fr
  LEFT JOIN diffs ON diffs.source_id = fr.source_id AND diffs.frame_index = fr.frame_index - 1 AND ahead = 1)"""

# Flash suppression told frame by frame.
CUTS = f"""{FRAMES},
flash AS (
  SELECT source_id, frame_index + 1 AS frame_index, min(frame_index + ahead) AS flash_end FROM diffs
  WHERE ahead > 1 AND d < 0.0135::DOUBLE GROUP BY 1, 2),
marked AS (
  SELECT s.source_id, s.frame_index, score, flash_end, s.frame_index > 0 AND score >= 0.08::DOUBLE AS candidate
  FROM scored s LEFT JOIN flash f ON f.source_id = s.source_id AND f.frame_index = s.frame_index),
told AS (
  SELECT source_id, frame_index, score, -1::BIGINT AS before_to, -1::BIGINT AS hidden_to, candidate, flash_end
  FROM marked WHERE frame_index = 0
  UNION ALL
  SELECT m.source_id, m.frame_index, m.score, t.hidden_to,
         CASE WHEN m.candidate AND m.frame_index > t.hidden_to AND m.flash_end IS NOT NULL THEN m.flash_end
              ELSE t.hidden_to END, m.candidate, m.flash_end
  FROM told t JOIN marked m ON m.source_id = t.source_id AND m.frame_index = t.frame_index + 1),
classed AS (
  SELECT source_id, frame_index, score, frame_index <= hidden_to AS hidden,
         candidate AND frame_index > before_to AND flash_end IS NULL AS is_cut FROM told),
runs AS (
  SELECT source_id, min(frame_index) AS first, count(*) AS n, max(score) AS peak FROM (
    SELECT *, frame_index - row_number() OVER (PARTITION BY source_id ORDER BY frame_index) AS isl FROM classed
    WHERE frame_index > 0 AND NOT hidden AND score >= 0.0135::DOUBLE AND score < 0.08::DOUBLE) GROUP BY source_id, isl),
gradual AS (
  SELECT source_id, (first + n // 2) * 100 AS boundary_ms, 'gradual_transition' AS boundary_type,
         least(1.0::DOUBLE, peak / 0.08::DOUBLE) AS confidence
  FROM runs WHERE n >= 2 AND peak <= 0.08::DOUBLE * 0.25::DOUBLE)"""

REGIONS = f"""reg AS (
  SELECT {ident('l_suppkey')} AS source_id, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS day_no, *
  FROM lineitem),
regions AS (
  SELECT source_id, printf('SHOT_%04d', CAST(floor(day_no / 365.0) AS BIGINT)) AS shot_id,
         printf('KEY_%06d', day_no) AS keyframe_id,
         'OCR_' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || row_number() OVER (
           PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus,
           l_shipdate, l_extendedprice) AS observation_id,
         day_no * 1000 AS timestamp_ms,
         l_returnflag || CASE WHEN l_linenumber % 2 = 0 THEN '  ' ELSE ' ' END || l_linestatus AS text,
         l_returnflag || ' ' || l_linestatus AS normalized_text,
         (l_partkey % 40 * 10)::DOUBLE AS x1, (l_linenumber * 30)::DOUBLE AS y1,
         (l_partkey % 40 * 10)::DOUBLE + 20 + l_quantity AS x2, (l_linenumber * 30)::DOUBLE + 24 AS y2,
         l_quantity * 2 AS ocr_confidence FROM reg)"""

# Frame signatures to shots: the steps above in one chain. Needs RECURSIVE.
FRAME_SHOTS = f"""{CUTS},
cand AS (
  SELECT source_id, frame_index * 100 AS boundary_ms, 'hard_cut' AS boundary_type, least(1.0, score) AS confidence
  FROM classed WHERE is_cut
  UNION ALL SELECT source_id, boundary_ms, boundary_type, confidence FROM gradual),
{_shots('fsrc', 500, 5000)}"""

# Text association as a walk over each (source, shot, text) with the list of its open tracks. Needs RECURSIVE.
TRACKS = f"""{REGIONS},
seq AS (SELECT *, row_number() OVER (PARTITION BY source_id, shot_id, normalized_text ORDER BY timestamp_ms, observation_id) AS rn FROM regions),
assoc AS (
  SELECT source_id, shot_id, normalized_text, 0::BIGINT AS rn,
         []::STRUCT(fid VARCHAR, fms BIGINT, lms BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[] AS open,
         NULL::VARCHAR AS obs, NULL::VARCHAR AS fid, NULL::BIGINT AS fms
  FROM (SELECT DISTINCT source_id, shot_id, normalized_text FROM regions)
  UNION ALL
  SELECT w.source_id, w.shot_id, w.normalized_text, r.rn,
         CASE WHEN c IS NULL THEN list_append(keep, {{'fid': r.observation_id, 'fms': r.timestamp_ms, 'lms': r.timestamp_ms,
                'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}})
              ELSE list_transform(keep, lambda t: CASE WHEN t.fid = c.fid THEN {{'fid': t.fid, 'fms': t.fms, 'lms': r.timestamp_ms,
                'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}} ELSE t END) END,
         r.observation_id, coalesce(c.fid, r.observation_id), coalesce(c.fms, r.timestamp_ms)
  FROM assoc w JOIN seq r ON r.source_id = w.source_id AND r.shot_id = w.shot_id AND r.normalized_text = w.normalized_text AND r.rn = w.rn + 1,
  LATERAL (SELECT list_filter(w.open, lambda t: r.timestamp_ms - t.lms <= 60000) AS keep) k,
  LATERAL (SELECT list_filter(keep, lambda t:
      greatest(least(t.x2, r.x2) - greatest(t.x1, r.x1), 0) * greatest(least(t.y2, r.y2) - greatest(t.y1, r.y1), 0)
      / (greatest(1, (t.x2 - t.x1) * (t.y2 - t.y1)) + greatest(1, (r.x2 - r.x1) * (r.y2 - r.y1))
         - greatest(least(t.x2, r.x2) - greatest(t.x1, r.x1), 0) * greatest(least(t.y2, r.y2) - greatest(t.y1, r.y1), 0)) >= 0.1
      OR (abs((t.x1 + t.x2) / 2 - (r.x1 + r.x2) / 2) <= greatest(t.x2 - t.x1, t.y2 - t.y1, r.x2 - r.x1, r.y2 - r.y1, 1)
          AND abs((t.y1 + t.y2) / 2 - (r.y1 + r.y2) / 2) <= greatest(t.x2 - t.x1, t.y2 - t.y1, r.x2 - r.x1, r.y2 - r.y1, 1)))[-1] AS c) f),
firsts AS (SELECT source_id, fid, row_number() OVER (PARTITION BY source_id ORDER BY fms, fid) AS track_no FROM assoc WHERE obs = fid),
members AS (
  SELECT r.*, track_no, printf('OCR_TRACK_%06d', track_no) AS track_id,
         row_number() OVER (PARTITION BY r.source_id, track_no ORDER BY timestamp_ms, observation_id) AS member_no
  FROM assoc a JOIN firsts f ON f.source_id = a.source_id AND f.fid = a.fid
  JOIN regions r ON r.source_id = a.source_id AND r.observation_id = a.obs)"""

TURNS = f"""turns AS (
  SELECT {ident('conv_id')} AS source_id, conv_id, turn, conv_id * 100 + turn AS number,
         printf('CUE_%06d', turn + 1) AS cue_id, turn * 2000 AS start_ms,
         turn * 2000 + 1500 + turn % 3 * 500 AS end_ms, role AS language, text FROM conversations),
tsrc AS (SELECT source_id, max(end_ms) + 1000 AS duration_ms FROM turns GROUP BY 1)"""

DOCS = f"""docs0 AS (
  SELECT doc_id, lang, n_chars, {ident('source')} AS source_id, printf('KEY_%06d', doc_id) AS keyframe_id,
         doc_id * 1000 AS timestamp_ms, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean, doc_id % 6 AS way
  FROM documents),
docs1 AS (SELECT *, string_split(clean, ' ') AS words FROM docs0),
docs AS (
  SELECT *, len(words) AS n,
         CASE WHEN way = 1 AND len(words) > 1 THEN length(clean) - length(words[1 + doc_id % len(words)]) - 1
              WHEN way = 2 THEN length(clean) + 1 WHEN way = 4 THEN 0 WHEN way = 5 THEN length(clean) + 3
              ELSE length(clean) END AS said_chars,
         CASE WHEN way = 1 AND len(words) > 1 THEN len(words) - 1 WHEN way = 4 THEN 0
              WHEN way = 5 THEN len(words) + 1 ELSE len(words) END AS said_words
  FROM docs1),
gold AS (
  SELECT *, CASE WHEN doc_id % 17 = 0 THEN '' ELSE clean END AS transcription,
         CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 3000 THEN 'medium' ELSE 'long' END AS size_name,
         CASE WHEN doc_id % 9 <> 0 THEN doc_id % 90 END AS max_height
  FROM docs WHERE doc_id % 13 <> 0),
scored AS (
  SELECT *, CAST(CASE WHEN transcription = '' THEN said_chars = 0 ELSE way IN (0, 3) OR (way = 1 AND n = 1) END AS BIGINT) AS exact,
         CASE WHEN transcription = '' THEN said_chars ELSE abs(said_chars - length(clean)) END AS char_edits,
         CASE WHEN transcription = '' THEN said_words WHEN way = 4 THEN n
              WHEN way IN (0, 3) OR (way = 1 AND n = 1) THEN 0 ELSE 1 END AS word_edits,
         length(transcription) AS chars, CASE WHEN transcription = '' THEN 0 ELSE n END AS nwords
  FROM gold)"""

RIGHTS = f"""csrc AS (
  SELECT c_custkey AS k, c_name, c_mktsegment, c_nationkey % 6 AS nation, {ident('c_custkey')} AS source_id,
         sha256(CAST(c_custkey AS VARCHAR)) AS content_sha256 FROM customer),
decl AS (
  SELECT k, CASE WHEN k % 23 = 0 THEN 'SRC_000000000000' ELSE source_id END AS source_id, content_sha256, c_name, c_mktsegment,
         ['owned', 'licensed', 'public-domain', 'other-documented-authorization', 'synthetic-controlled'][1 + k % 5] AS basis,
         k % 5 <> 0 AS p_analysis, k % 3 <> 0 AS p_annotation, k % 2 <> 0 AS p_training, k % 4 <> 0 AS p_evaluation,
         k % 7 <> 0 AS p_retention, k % 6 <> 0 AS p_redistribution, nation, k % 2 = 0 AS reviewed,
         sha256('m' || k) AS manifest_hash, k % 29 = 0 AS twice
  FROM csrc WHERE k % 19 <> 0)"""

BOUNDARIES = f"""{EV},
pred AS (
  SELECT source_id, event_id AS pred_id, ms // 200000 AS boundary_ms,
         CASE WHEN event_id % 5 = 0 THEN 'uncertain' ELSE 'hard_cut' END AS boundary_type FROM ev),
gold AS (
  SELECT source_id, event_id AS gold_id, ms // 200000 + event_id % 401 - 200 AS boundary_ms,
         CASE WHEN event_id % 3 = 0 THEN 'gradual_transition' ELSE 'hard_cut' END AS transition_type,
         CASE WHEN event_id % 4 = 0 THEN 120 WHEN event_id % 4 = 1 THEN 900 ELSE 250 END AS tol
  FROM ev WHERE event_id % 7 <> 0),
gn AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY boundary_ms, tol, gold_id) AS g FROM gold),
pn AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY boundary_ms, pred_id) AS p FROM pred),
opts AS (
  SELECT gn.source_id, g, p, abs(gn.boundary_ms - pn.boundary_ms) AS err
  FROM gn JOIN pn ON gn.source_id = pn.source_id AND abs(gn.boundary_ms - pn.boundary_ms) <= tol),
lists AS (SELECT source_id, g, list(p ORDER BY err, p) AS ps FROM opts GROUP BY 1, 2),
walk AS (
  SELECT source_id, 0::BIGINT AS g, []::BIGINT[] AS used, NULL::BIGINT AS got FROM src
  UNION ALL
  SELECT w.source_id, w.g + 1,
         CASE WHEN x.pick IS NULL THEN w.used ELSE list_append(w.used, x.pick) END, x.pick
  FROM walk w JOIN (SELECT source_id, max(g) AS n FROM gn GROUP BY 1) m
    ON m.source_id = w.source_id AND w.g < m.n
  LEFT JOIN lists l ON l.source_id = w.source_id AND l.g = w.g + 1,
  LATERAL (SELECT list_filter(coalesce(l.ps, []::BIGINT[]), lambda q: NOT list_contains(w.used, q))[1] AS pick) x),
matches AS (
  SELECT w.source_id, gold_id, pred_id, abs(gn.boundary_ms - pn.boundary_ms) AS error_ms, transition_type, boundary_type
  FROM walk w JOIN gn ON gn.source_id = w.source_id AND gn.g = w.g
  JOIN pn ON pn.source_id = w.source_id AND pn.p = w.got)"""


def prf(correct: str, predicted: str, gold: str) -> str:
    p = f"(CASE WHEN {predicted} > 0 THEN {correct}::DOUBLE / {predicted} WHEN {gold} = 0 THEN 1.0 ELSE 0.0 END)"
    r = f"(CASE WHEN {gold} > 0 THEN {correct}::DOUBLE / {gold} WHEN {predicted} = 0 THEN 1.0 ELSE 0.0 END)"
    return (
        f"{correct} AS correct, {predicted} AS predicted, {gold} AS gold, round({p}, 6) AS precision, "
        f"round({r}, 6) AS recall, round(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END, 6) AS f1"
    )


def presence(tp: str, fp: str, fn: str) -> str:
    p, r = f"({tp}::DOUBLE / nullif({tp} + {fp}, 0))", f"({tp}::DOUBLE / nullif({tp} + {fn}, 0))"
    return (
        f"round({p}, 6) AS precision, round({r}, 6) AS recall, "
        f"round(2 * {p} * {r} / nullif({p} + {r}, 0), 6) AS f1"
    )
