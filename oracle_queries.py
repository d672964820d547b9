"""DuckDB statements that state the expected result of every registered query."""

from __future__ import annotations

# --- shared parts -------------------------------------------------------------

CORPUS = "corpus AS (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text)"

BENCHMARK_Q = "SELECT item_id AS qid, text AS question FROM benchmark"

GOLD = "gold AS (SELECT item_id AS qid, doc_id, b.text AS question, c.text AS text FROM corpus c JOIN benchmark b ON contains(c.text, b.text))"

BM25_INDEX = f"""{CORPUS},
tok AS (SELECT doc_id, unnest(string_split(text, ' ')) AS term FROM corpus),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id, count(*) AS dl FROM tok GROUP BY doc_id),
st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl),
dfreq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, df, ln((SELECT n_docs FROM st) - df + 0.5) - ln(df + 0.5) AS raw FROM dfreq),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END AS idf FROM raw)"""

RANKED = """ranked AS (SELECT qid, doc_id, score,
  row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored)"""

SHOW_HITS = "SELECT qid, rank, doc_id, round(score, 4) AS score FROM {name}"


def bm25(question_sql: str, k: int) -> str:
    return f"""{BM25_INDEX},
q AS ({question_sql}),
qtf AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(string_split(question, ' ')) AS term FROM q) GROUP BY ALL),
scored AS (SELECT qid, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM qtf JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), st GROUP BY qid, doc_id),
{RANKED},
hits AS (SELECT * FROM ranked WHERE rank <= {k})"""


CONTEXTS = "ctx AS (SELECT qid, string_agg(text, ' ' ORDER BY rank) AS context FROM hits JOIN corpus USING (doc_id) GROUP BY qid)"


def grams(source: str, id_col: str, text: str) -> str:
    """Lower-cased 1-2-grams of a text column, one row each."""
    return f"""(SELECT {id_col}, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term
  FROM (SELECT {id_col}, string_split(lower({text}), ' ') AS t FROM {source}))"""


def tfidf_vocab(max_features: int) -> str:
    return f"""{CORPUS},
gram AS (SELECT doc_id, term, count(*) AS tf FROM {grams('corpus', 'doc_id', 'text')} GROUP BY ALL),
vocab AS (SELECT term, sum(tf)::BIGINT AS total, count(*) AS df,
  ln((1 + (SELECT count(*) FROM corpus)) / (1 + count(*))) + 1 AS idf
  FROM gram GROUP BY term ORDER BY total DESC, term LIMIT {max_features})"""


def tfidf_vectors(max_features: int) -> str:
    return f"""{tfidf_vocab(max_features)},
dw AS (SELECT doc_id, term, tf * idf AS w FROM gram JOIN vocab USING (term)),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM dw GROUP BY doc_id),
dvec AS (SELECT doc_id, term, w / norm AS weight FROM dw JOIN dn USING (doc_id))"""


def tfidf_hits(question_sql: str, k: int) -> str:
    return f"""{tfidf_vectors(50000)},
q AS ({question_sql}),
qw AS (SELECT qid, term, count(*) * any_value(idf) AS w FROM {grams('q', 'qid', 'question')} JOIN vocab USING (term) GROUP BY qid, term),
qn AS (SELECT qid, sqrt(sum(w * w)) AS norm FROM qw GROUP BY qid),
scored AS (SELECT qid, doc_id, sum(w / norm * weight) AS score FROM qw JOIN qn USING (qid) JOIN dvec USING (term) GROUP BY qid, doc_id),
{RANKED},
hits AS (SELECT * FROM ranked WHERE rank <= {k})"""


def encoded(name: str, source: str, id_col: str, text: str) -> str:
    """Signed hashed bag of words of a text column: ``name(id_col, v double[])``."""
    return f"""{name}_slot AS (SELECT {id_col}, ('0x' || substr(h, 1, 8))::BIGINT % 64 AS dim, CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END AS sgn
  FROM (SELECT {id_col}, md5(unnest(string_split({text}, ' '))) AS h FROM {source})),
{name}_full AS (SELECT i.{id_col}, d.dim, coalesce(s.v, 0) AS v FROM (SELECT {id_col} FROM {source}) i, (SELECT unnest(range(64)) AS dim) d
  LEFT JOIN (SELECT {id_col}, dim, sum(sgn)::BIGINT AS v FROM {name}_slot GROUP BY ALL) s ON s.{id_col} = i.{id_col} AND s.dim = d.dim),
{name}_norm AS (SELECT {id_col}, sqrt(sum(v * v)::DOUBLE) AS norm FROM {name}_full GROUP BY {id_col}),
{name} AS (SELECT {id_col}, list((CASE WHEN norm > 0 THEN v / norm ELSE 0 END)::FLOAT::DOUBLE ORDER BY dim) AS v
  FROM {name}_full JOIN {name}_norm USING ({id_col}) GROUP BY {id_col})"""


def vector_hits(k: int, name: str = "hits") -> str:
    """Exact top k of ``qv(qid, v)`` over ``pv(doc_id, v)``."""
    return f"""{name} AS (SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank
  FROM (SELECT qid, doc_id, list_inner_product(qv.v, pv.v) AS score FROM qv, pv)) WHERE rank <= {k})"""


EMBEDDED = """qv AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings),
pv AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings)"""

CENTROIDS = """comp AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
cent AS (SELECT label AS cluster_id, list(m ORDER BY dim) AS c FROM (SELECT label, dim, avg(x) AS m FROM comp GROUP BY ALL) GROUP BY label)"""


def distance(a: str, b: str, metric: str) -> str:
    if metric == "inner_product":
        return f"list_inner_product({a}, {b})"
    return f"list_inner_product({a}, {a}) + list_inner_product({b}, {b}) - 2 * list_inner_product({a}, {b})"


def ivf_hits(metric: str, nprobe: int, k: int) -> str:
    way = "DESC" if metric == "inner_product" else "ASC"
    return f"""{CENTROIDS},
near AS (SELECT id, cluster_id, row_number() OVER (PARTITION BY id ORDER BY round(s, 6) {way}, cluster_id) AS r
  FROM (SELECT doc_id AS id, cluster_id, {distance('v', 'c', metric)} AS s FROM pv, cent)),
cell AS (SELECT doc_id, v, cluster_id FROM pv JOIN near ON near.id = pv.doc_id AND r = 1),
probe AS (SELECT qid, v, cluster_id FROM (SELECT qid, v, cluster_id, row_number() OVER (PARTITION BY qid ORDER BY round({distance('v', 'c', metric)}, 6) {way}, cluster_id) AS r FROM qv, cent) WHERE r <= {nprobe}),
hits AS (SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) {way}, doc_id) AS rank
  FROM (SELECT qid, doc_id, {distance('probe.v', 'cell.v', metric)} AS score FROM probe JOIN cell USING (cluster_id))) WHERE rank <= {k})"""


def coded(bits: int, metric: str) -> str:
    """``pv`` with the vectors that stand for the packed codes: each component at its step between the dimension's bounds."""
    levels = (1 << bits) - 1
    unit = "v / sqrt(sum(v * v) OVER (PARTITION BY doc_id))" if metric == "inner_product" else "v"
    return f"""raw AS (SELECT vec_id AS doc_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings),
unit AS (SELECT doc_id, dim, {unit} AS v FROM raw),
lim AS (SELECT dim, min(v) AS lo, max(v) AS hi FROM unit GROUP BY dim),
whole AS (SELECT doc_id, list(v ORDER BY dim) AS v FROM unit GROUP BY doc_id),
near_steps AS (SELECT doc_id, list(lo + floor((v - lo) / (hi - lo) * {levels} + 0.5) / {levels} * (hi - lo) ORDER BY dim) AS code FROM unit JOIN lim USING (dim) GROUP BY doc_id),
pv AS (SELECT doc_id, v, code FROM whole JOIN near_steps USING (doc_id)),
qv AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings)"""


def coded_hits(bits: int, metric: str, nprobe: int, k: int) -> str:
    """Cells are chosen by the vectors themselves, scores come from the codes."""
    hits = ivf_hits(metric, nprobe, k).replace("cell AS (SELECT doc_id, v,", "cell AS (SELECT doc_id, code AS v,")
    return f"{coded(bits, metric)}, {hits}"


GOLD_EXAMPLES = "ex AS (SELECT qid || '-' || doc_id AS id, question, text AS gold_text FROM gold)"

WINDOWS = """ex AS (SELECT doc_id AS id, lang || ' ' || source AS question, text AS context, string_split(text, ' ') AS toks FROM documents),
sz AS (SELECT *, len(string_split(question, ' ')) AS nq, 384 - 3 - nq AS cap, len(toks) AS n FROM ex),
win AS (SELECT id, nq, cap, n, unnest(range(0, 1 + greatest(0, ceil((n - cap) / (cap - 128))::BIGINT))) AS chunk FROM sz),
pos AS (SELECT id, unnest(toks) AS t, generate_subscripts(toks, 1) - 1 AS i FROM sz),
offs AS (SELECT id, i, t, i + coalesce(sum(length(t)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, length(t) AS w FROM pos),
wtok AS (SELECT id, chunk, nq + 2 AS context_start, chunk * (cap - 128) AS token_start, i, t, s::BIGINT AS s, (s + w)::BIGINT AS e, nq + 2 + i - chunk * (cap - 128) AS p
  FROM win JOIN offs USING (id) WHERE i >= chunk * (cap - 128) AND i < chunk * (cap - 128) + cap)"""

WORD_WINDOWS = """WITH c AS (SELECT doc_id AS id, 384 - 3 - len(regexp_extract_all(lang || ' ' || source, '[^ .,|!\\n]+')) AS cap,
  regexp_extract_all(text, '[^ .,|!\\n]+') AS toks, regexp_split_to_array(text, '[^ .,|!\\n]+') AS gaps FROM documents),
p AS (SELECT id, cap, len(toks) AS n, unnest(toks) AS t, unnest(gaps[1:len(toks)]) AS g, generate_subscripts(toks, 1) - 1 AS i FROM c),
o AS (SELECT *, sum(length(t) + length(g)) OVER (PARTITION BY id ORDER BY i) AS e FROM p),
w AS (SELECT DISTINCT id, cap, unnest(range(0, 1 + greatest(0, ceil((n - cap) / (cap - 128))::BIGINT))) AS chunk FROM p)
SELECT o.id, w.chunk, w.chunk * (w.cap - 128) AS token_start, count(*) AS n_tokens, md5(string_agg(t, ' ' ORDER BY i)) AS tokens_md5,
  sum((e - length(t)) * 3 + e)::BIGINT AS offset_sum
FROM o JOIN w ON o.id = w.id AND i >= w.chunk * (w.cap - 128) AND i < w.chunk * (w.cap - 128) + w.cap GROUP BY ALL"""

ANSWERS = """ans AS (SELECT doc_id AS id, mid, length(array_to_string(toks[1:mid], ' ')) + CASE WHEN mid > 0 THEN 1 ELSE 0 END AS a, length(toks[mid + 1]) AS w
  FROM (SELECT doc_id, string_split(text, ' ') AS toks, len(string_split(text, ' ')) // 2 AS mid FROM documents JOIN labels USING (doc_id) WHERE quality = 1))"""

LOGITS = f"""{WINDOWS},
grid AS (SELECT id, chunk, unnest(range(384)) AS p FROM win),
feat AS (SELECT g.id, g.chunk, g.p, w.s, w.e,
  (g.id * 31 + g.chunk * 17 + g.p * 7919 + coalesce(w.e - w.s, 0) * 613) % 997 / 100.0::DOUBLE AS sl,
  (g.id * 37 + g.chunk * 17 + g.p * 6007 + coalesce(w.e - w.s, 0) * 613) % 997 / 100.0::DOUBLE AS el
  FROM grid g LEFT JOIN wtok w ON w.id = g.id AND w.chunk = g.chunk AND w.p = g.p),
ord AS (SELECT *, row_number() OVER (PARTITION BY id, chunk ORDER BY sl DESC, p DESC) AS sr, row_number() OVER (PARTITION BY id, chunk ORDER BY el DESC, p DESC) AS er FROM feat)"""

PAIRS = f"""{LOGITS},
pairs AS (SELECT id, chunk, a.sl + b.el AS score, a.sr - 1 AS start_rank, b.er - 1 AS end_rank, a.p AS start_pos, b.p AS end_pos, a.sl, b.el, a.s, b.e
  FROM (SELECT id, chunk, sr, p, sl, s FROM ord WHERE sr <= 20 AND s IS NOT NULL) a
  JOIN (SELECT id, chunk, er, p, el, s, e FROM ord WHERE er <= 20 AND s IS NOT NULL) b USING (id, chunk)
  WHERE b.p - a.p BETWEEN 0 AND 29)"""

NULLS = "nul AS (SELECT id, min(sl + el) AS null_score FROM feat WHERE p = 0 GROUP BY id)"

NBEST = f"""{PAIRS},
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk, start_rank, end_rank) AS r FROM pairs) WHERE r <= 20),
texts AS (SELECT id, r, sl, el, score, substr(context, s + 1, e - s) AS text FROM top JOIN ex USING (id)),
few AS (SELECT id, count(x.r) = 0 OR (count(x.r) = 1 AND max(x.text) = '') AS blank FROM ex LEFT JOIN texts x USING (id) GROUP BY id),
full_list AS (SELECT id, r + CASE WHEN blank THEN 1 ELSE 0 END AS rank, text, sl, el, score FROM texts JOIN few USING (id)
  UNION ALL SELECT id, 1, 'empty', 0.0, 0.0, 0.0 FROM few WHERE blank),
nbest AS (SELECT id, rank, text, sl, el, exp(score - max(score) OVER w) / sum(exp(score - m)) OVER w AS probability
  FROM (SELECT *, max(score) OVER (PARTITION BY id) AS m FROM full_list) WINDOW w AS (PARTITION BY id))"""

NBEST_NULL = f"""{PAIRS}, {NULLS},
nulrow AS (SELECT id, sl + el AS score, sl, el, row_number() OVER (PARTITION BY id ORDER BY sl + el, chunk) AS r FROM feat WHERE p = 0),
cand AS (SELECT id, score, chunk, start_rank, end_rank, sl, el, s, e FROM pairs
  UNION ALL SELECT id, score, 9000000000, 0, 0, sl, el, 0, 0 FROM nulrow WHERE r = 1),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk, start_rank, end_rank) AS r FROM cand) WHERE r <= 20),
texts AS (SELECT id, r, sl, el, substr(context, s + 1, e - s) AS text FROM top JOIN ex USING (id)),
first AS (SELECT id, arg_min(text, r) AS text, arg_min(sl, r) AS sl, arg_min(el, r) AS el, count(*) AS n FROM texts WHERE text <> '' GROUP BY id),
pick AS (SELECT id, null_score, coalesce(text, 'empty') AS text, coalesce(sl, 0.0) AS sl, coalesce(el, 0.0) AS el FROM ex LEFT JOIN first f USING (id) JOIN nul USING (id))"""

MODEL_NAMES = ("base", "partner", "challenger", "fourth", "fifth")

MODELS = """val AS (SELECT vec_id AS id, (generate_subscripts(embedding, 1) - 1) // 16 + 1 AS m, (generate_subscripts(embedding, 1) - 1) % 16 + 1 AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings
  UNION ALL SELECT id, 5, j, (v[j] + v[j + 16] + v[j + 32] + v[j + 48]) / 4 FROM (SELECT vec_id AS id, embedding::DOUBLE[] AS v, unnest(range(1, 17)) AS j FROM embeddings)),
ent AS (SELECT id, m, row_number() OVER (PARTITION BY id, m ORDER BY x DESC, 'a' || (pos % 3)) AS rank, 'a' || (pos % 3) AS text,
  exp(x * 20 - max(x * 20) OVER (PARTITION BY id, m)) AS ex FROM val),
nb AS (SELECT id, m, rank, text, ex / sum(ex) OVER (PARTITION BY id, m) AS p FROM ent),
tab AS (SELECT id, """ + ", ".join(
    f"max(CASE WHEN m = {i} AND rank = 1 THEN text END) AS {n}_text, max(CASE WHEN m = {i} THEN p END) AS {n}_p" for i, n in enumerate(MODEL_NAMES, 1)
) + " FROM nb GROUP BY id)"

RULED = f"""{MODELS},
ruled AS (SELECT *, (base_p + partner_p) / 2 < 0.35 AS rule1,
  base_p + 0.35 <= challenger_p AND base_text <> challenger_text AS rule2,
  (base_p + partner_p) / 2 + 0.3 <= challenger_p AND base_text = partner_text AND base_text <> challenger_text AS rule3 FROM tab)"""

PUNCTUATION = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
SPACE_CLASS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def squad_words(text: str) -> str:
    return f"""list_filter(string_split(regexp_replace(translate(lower({text}), '{PUNCTUATION}', ''), '{SPACE_CLASS}', ' ', 'g'), ' '),
  lambda x: x <> '' AND x NOT IN ('a', 'an', 'the'))"""


SQUAD = f"""turns AS (SELECT conv_id || '-' || turn AS id, c.text AS prediction,
  [CASE WHEN c.role = 'user' THEN 'The ' || c.text || '!' ELSE 'none' END, coalesce(n.text, '')] AS refs
  FROM conversations c LEFT JOIN (SELECT conv_id, turn - 1 AS turn, text FROM conversations) n USING (conv_id, turn)),
pr AS (SELECT id, {squad_words('prediction')} AS p, r, {squad_words('refs[r]')} AS t FROM (SELECT *, unnest([1, 2]) AS r FROM turns)),
pc AS (SELECT id, r, w, count(*) AS n FROM (SELECT id, r, unnest(p) AS w FROM pr) GROUP BY ALL),
tc AS (SELECT id, r, w, count(*) AS n FROM (SELECT id, r, unnest(t) AS w FROM pr) GROUP BY ALL),
ov AS (SELECT id, r, sum(least(pc.n, tc.n)) AS same FROM pc JOIN tc USING (id, r, w) GROUP BY id, r),
sc AS (SELECT id, max(CASE WHEN array_to_string(p, ' ') = array_to_string(t, ' ') THEN 1.0 ELSE 0.0 END)::DOUBLE AS em,
  max(coalesce(2.0 * same / (len(p) + len(t)), 0))::DOUBLE AS f1 FROM pr LEFT JOIN ov USING (id, r) GROUP BY id)"""

BATCHES = """pairs AS (SELECT vec_id // 4 AS batch, vec_id AS item, embedding::DOUBLE[] AS q, list_reverse(embedding)::DOUBLE[] AS p,
  list_concat(embedding[33:64], embedding[1:32])::DOUBLE[] AS hard FROM embeddings)"""


def batch_loss(candidates: str) -> str:
    return f"""WITH {BATCHES}, cand AS ({candidates}),
s AS (SELECT a.batch, a.item, list_inner_product(a.q, c.v) AS x, c.own AND a.item = c.item AS target FROM pairs a JOIN cand c USING (batch)),
l AS (SELECT batch, item, max(x) + ln(sum(exp(x - m))) - max(CASE WHEN target THEN x END) AS loss
  FROM (SELECT *, max(x) OVER (PARTITION BY batch, item) AS m FROM s) GROUP BY batch, item)
SELECT batch, round(avg(loss), 4) AS loss FROM l GROUP BY batch"""


def statements(question: str) -> dict[str, str]:
    one = f"SELECT 0::BIGINT AS qid, '{question}' AS question"
    single_vector = encoded("qv", "one", "qid", "question")
    top10 = f"WITH {bm25(BENCHMARK_Q, 10)}"
    show = SHOW_HITS.format(name="hits")
    deduped = "(SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text)"
    lines = "(SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
    not_blank = f"regexp_replace(text, '{SPACE_CLASS}', '', 'g') <> ''"
    breaks = r"( |\n|\\n)+"
    quotes = "''\"《》<>〈〉‘’「」"
    bm25_hits = f"{top10} {show}"
    dense_hits = f"WITH {EMBEDDED}, {vector_hits(10)} {show}"
    out: dict[str, str] = {}

    # Sources and sinks: what was written must come back.
    out["read_corpus_json"] = f"WITH {CORPUS} SELECT doc_id, doc_id AS document_id, md5(text) AS text_md5 FROM corpus"
    out["read_text_lines"] = f"SELECT md5(text) AS line_md5, count(*) AS n FROM {lines} GROUP BY text"
    out["flatten_nested_qa"] = """SELECT conv_id::VARCHAR AS title, conv_id || '-' || turn AS id, role AS question, md5(text) AS context_md5,
  0::BIGINT AS answer_start, md5(text) AS answer_md5 FROM conversations"""
    out["qa_roundtrip"] = """SELECT doc_id::VARCHAR AS id, CASE WHEN ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 10000 < 1000 THEN 'validation' ELSE 'train' END AS split,
  lang || ' ' || source AS question, CASE WHEN quality = 1 THEN 1 ELSE 0 END::BIGINT AS n_answers, md5(text) AS context_md5 FROM documents LEFT JOIN labels USING (doc_id)"""
    out["predictions_from_json"] = f"WITH {MODELS} SELECT id::VARCHAR AS id, base_text AS text FROM tab"
    out["predictions_to_json"] = f"WITH {NBEST} SELECT id::VARCHAR AS id, text FROM nbest WHERE rank = 1"
    out["nbest_from_json"] = f"""WITH {NBEST} SELECT id::VARCHAR AS id, rank, md5(text) AS text_md5, round(sl, 4)::DOUBLE AS start_logit, round(el, 4)::DOUBLE AS end_logit,
  round(probability, 4) AS probability FROM nbest"""
    out["csv_roundtrip"] = f"{top10} SELECT qid, rank, doc_id, md5(text) AS text_md5 FROM hits JOIN corpus USING (doc_id)"
    out["bm25_persisted"] = bm25_hits
    out["bm25_persisted_single"] = f"WITH {bm25(one, 10)} {show}"
    out["tfidf_persisted"] = f"WITH {tfidf_hits(BENCHMARK_Q, 10)} {show}"
    out["tfidf_persisted_single"] = f"WITH {tfidf_hits(one, 10)} {show}"
    out["dense_persisted"] = dense_hits
    out["encode_truncated"] = f"""WITH short AS (SELECT doc_id, array_to_string(string_split(text, ' ')[1:32], ' ') AS text FROM documents),
  {encoded('pv', 'short', 'doc_id', 'text')} SELECT doc_id, generate_subscripts(v, 1) - 1 AS dim, round(unnest(v), 4) AS v FROM pv"""
    out["chunk_windows_words"] = WORD_WINDOWS
    out["reader_input"] = f"""{top10}, {CONTEXTS} SELECT md5(coalesce(context, '')) AS context_md5, item_id::VARCHAR AS id, text AS question
  FROM benchmark LEFT JOIN ctx ON qid = item_id"""

    # Corpus.
    out["dedup_corpus"] = f"WITH {CORPUS} SELECT doc_id, md5(text) AS text_md5 FROM corpus"
    out["concat_splits"] = """SELECT doc_id, lang, md5(text) AS text_md5 FROM documents UNION ALL SELECT item_id, '-', md5(text) FROM benchmark"""
    out["drop_columns"] = "SELECT doc_id, lang, source FROM documents"
    out["hash_split"] = """SELECT doc_id, CASE WHEN ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 10000 < 1000 THEN 'validation' ELSE 'train' END AS split FROM documents"""
    out["percent_slice"] = """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= round((SELECT count(*) FROM documents) * 0.05) THEN 'validation' ELSE 'train' END AS split FROM documents"""
    out["take_first"] = "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100"
    out["drop_blank_lines"] = f"SELECT doc_id, line_no, md5(text) AS line_md5 FROM {lines} WHERE {not_blank}"
    out["normalize_ws"] = f"SELECT doc_id, md5(t) AS text_md5, length(t) AS n FROM (SELECT doc_id, regexp_replace(text, '{breaks}', ' ', 'g') AS t FROM documents)"
    out["compact_key"] = f"SELECT doc_id, md5(t) AS text_md5, length(t) AS n FROM (SELECT doc_id, regexp_replace(text, '{breaks}', '', 'g') AS t FROM documents)"
    out["normalize_answer"] = f"""SELECT page_id, md5(t) AS html_md5, length(t) AS n FROM
  (SELECT page_id, trim(regexp_replace(translate(html, '{quotes}', '{' ' * 13}'), '{SPACE_CLASS}', ' ', 'g')) AS t FROM pages)"""
    out["resolve_columns"] = "SELECT lang AS question, md5(text) AS text_md5, doc_id AS id FROM documents"

    # Tokens.
    out["token_counts"] = "SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, string_split(text, ' ') AS t FROM documents)"
    out["ngrams_12"] = """SELECT doc_id, len(g) AS n, md5(array_to_string(g, '|')) AS grams_md5 FROM (SELECT doc_id,
  list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS g FROM (SELECT doc_id, string_split(lower(text), ' ') AS t FROM documents))"""
    out["pad_truncate"] = """SELECT doc_id, md5(array_to_string(list_concat(t[1:512], list_transform(range(0, greatest(0, 512 - len(t))), lambda i: '[PAD]')), ' ')) AS ids_md5,
  least(512, len(t)) AS n_real FROM (SELECT doc_id, string_split(text, ' ') AS t FROM documents)"""

    # Sparse retrieval.
    out["bm25_idf"] = f"WITH {BM25_INDEX} SELECT term, df, round(idf, 4) AS idf FROM idf"
    out["bm25_topk"] = bm25_hits
    out["bm25_topk_block"] = bm25_hits
    out["bm25_single"] = out["bm25_persisted_single"]
    out["tfidf_vocab"] = f"WITH {tfidf_vocab(50000)} SELECT term, total, df, round(idf, 4) AS idf FROM vocab"
    out["tfidf_vectors"] = f"WITH {tfidf_vectors(50000)} SELECT doc_id, term, round(weight, 4) AS weight FROM dvec"
    out["tfidf_topk"] = f"WITH {tfidf_hits(BENCHMARK_Q, 10)} {show}"
    out["tfidf_single"] = f"WITH {tfidf_hits(one, 10)} {show}"
    out["oov_questions"] = f"""WITH {tfidf_vocab(50000)}, q AS (SELECT DISTINCT unnest(string_split(lower(html), ' ')) AS question FROM pages)
  SELECT md5(question) AS qid FROM q ANTI JOIN vocab ON term = question"""
    rounds = "".join(
        f""",
image{i} AS MATERIALIZED (SELECT doc_id, sum(weight * v) AS p FROM cells JOIN way{i} USING (term) GROUP BY doc_id),
way{i + 1} AS MATERIALIZED (SELECT term, w / sqrt(sum(w * w) OVER ()) AS v FROM (SELECT term, sum(weight * p) AS w FROM cells JOIN image{i} USING (doc_id) GROUP BY term))"""
        for i in range(64)
    )
    # The first component by powers of the matrix; other components have no short statement.
    out["lsa_fit"] = f"""WITH {tfidf_vectors(50000)},
cells AS MATERIALIZED (SELECT doc_id, term, weight FROM dvec),
way0 AS (SELECT DISTINCT term, 1.0::DOUBLE AS v FROM cells){rounds},
last AS (SELECT doc_id, sum(weight * v) AS p FROM cells JOIN way64 USING (term) GROUP BY doc_id)
SELECT doc_id, round(coalesce(p, 0), 4) AS first, round((SELECT sqrt(sum(p * p)) FROM last), 4) AS value,
  round((SELECT sum(weight * weight) FROM cells), 4) AS total FROM corpus LEFT JOIN last USING (doc_id)"""
    out["lsa_topk"] = "SELECT item_id AS qid, unnest(range(1, 11)) AS rank, true AS best FROM benchmark"
    out["ivf_lsa_topk"] = out["lsa_topk"]
    out["ivf_build"] = "SELECT vec_id AS doc_id, true AS nearest FROM embeddings"
    out["encode_hash"] = f"WITH {encoded('pv', 'documents', 'doc_id', 'text')} SELECT doc_id, generate_subscripts(v, 1) - 1 AS dim, round(unnest(v), 4) AS v FROM pv"
    out["dense_topk"] = dense_hits
    out["dense_topk_block"] = dense_hits
    out["dense_single"] = f"WITH {CORPUS}, one AS ({one}), {encoded('pv', 'corpus', 'doc_id', 'text')}, {single_vector}, {vector_hits(10)} {show}"
    out["l2_normalized"] = """WITH c AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE * 3 + 1 AS x FROM embeddings)
SELECT vec_id, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 4) AS u FROM c"""
    out["ivf_assign"] = f"""WITH {EMBEDDED}, {CENTROIDS} SELECT doc_id, cluster_id::BIGINT AS cluster_id FROM
  (SELECT doc_id, cluster_id, row_number() OVER (PARTITION BY doc_id ORDER BY round({distance('v', 'c', 'l2')}, 6), cluster_id) AS r FROM pv, cent) WHERE r = 1"""
    out["scalar_quantize"] = """WITH c AS (SELECT vec_id, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
b AS (SELECT dim, min(x) AS lo, max(x) AS hi FROM c GROUP BY dim),
k AS (SELECT vec_id, dim, lo, hi, floor((x - lo) / (hi - lo) * 255 + 0.5)::INT AS c8, floor((x - lo) / (hi - lo) * 15 + 0.5)::INT AS c4 FROM c JOIN b USING (dim))
SELECT vec_id, string_agg(c8, ',' ORDER BY dim) AS c8, string_agg(c4, ',' ORDER BY dim) AS c4, round(sum(lo + c8 / 255 * (hi - lo)), 4) AS decoded_sum FROM k GROUP BY vec_id"""
    out["ivf_topk_ip"] = f"WITH {EMBEDDED}, {ivf_hits('inner_product', 1, 10)} {show}"
    out["ivf_topk_l2"] = f"WITH {EMBEDDED}, {ivf_hits('l2', 2, 10)} {show}"
    passages = "pv AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings)"
    out["ivf_single"] = f"WITH {passages}, one AS ({one}), {single_vector}, {ivf_hits('inner_product', 1, 10)} {show}"

    out["ivf_persisted_single"] = out["ivf_single"]
    out["ivf_quantized_topk"] = f"WITH {coded_hits(8, 'inner_product', 2, 10)} {show}"
    out["ivf_quantized_l2"] = f"WITH {coded_hits(4, 'l2', 1, 10)} {show}"
    own_question = coded_hits(8, "l2", 2, 10).replace("qv AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings)", single_vector)
    out["ivf_quantized_single"] = f"WITH one AS ({one}), {own_question} {show}"

    # Fusion.
    out["hybrid_topk"] = f"""WITH {bm25(BENCHMARK_Q, 300)}, {encoded('pv', 'corpus', 'doc_id', 'text')}, {encoded('qv', 'q', 'qid', 'question')},
{vector_hits(300, 'near')},
fused AS (SELECT h.qid, h.doc_id, h.score + 5.0 * coalesce(n.score, 0) AS score FROM hits h LEFT JOIN near n ON n.qid = h.qid AND n.doc_id = h.doc_id),
best AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM fused)
SELECT qid, rank, doc_id, round(score, 4) AS score FROM best WHERE rank <= 10"""
    out["assemble_context"] = f"{top10}, {CONTEXTS} SELECT qid, md5(context) AS context_md5, length(context) AS n FROM ctx"
    out["attach_gold"] = f"""{top10}, {CONTEXTS}, {GOLD} SELECT qid || '-' || doc_id AS id, md5(context) AS context_md5, md5(text) AS gold_md5, md5(question) AS answer_md5 FROM gold JOIN ctx USING (qid)"""
    out["retrieve_flow"] = f"""{top10}, {CONTEXTS}, r AS (SELECT item_id AS id, text, coalesce(context, '') AS context FROM benchmark LEFT JOIN ctx ON qid = item_id)
SELECT id, md5(text) AS question_md5, md5(context) AS context_md5, len(string_split(context, ' ')) AS n_tokens, contains(context, text)::BIGINT AS has_question FROM r"""

    # Metrics.
    out["contains_accuracy"] = f"""{top10}, {CONTEXTS} SELECT count(*) AS n, round(avg(contains(coalesce(context, ''), text)::INT) * 100, 4) AS accuracy FROM benchmark LEFT JOIN ctx ON qid = item_id"""
    best = f"""WITH {bm25(BENCHMARK_Q, 100)}, {GOLD},
best AS (SELECT g.qid, min(rank) AS best_rank FROM gold g LEFT JOIN hits h ON h.qid = g.qid AND h.doc_id = g.doc_id GROUP BY g.qid)"""
    out["recall_at_k"] = f"""{best} SELECT k::BIGINT AS k, round(avg(CASE WHEN best_rank <= k THEN 1.0 ELSE 0.0 END) * 100, 4) AS recall
  FROM best, (SELECT unnest([10, 20, 30, 50, 100]) AS k) GROUP BY k"""
    out["recall_detail"] = f"""{best} SELECT qid, coalesce(best_rank, -1) AS best_rank, CASE WHEN best_rank <= 10 THEN 1 ELSE 0 END::BIGINT AS is_in,
  coalesce((SELECT string_agg(doc_id, ' ' ORDER BY rank) FROM hits h WHERE h.qid = best.qid AND rank <= 10), '') AS top_ids FROM best"""
    out["squad_em"] = f"WITH {SQUAD} SELECT id, em FROM sc"
    out["squad_f1"] = f"WITH {SQUAD} SELECT id, round(f1, 4) AS f1 FROM sc"
    out["squad_metrics"] = f"WITH {SQUAD} SELECT count(*) AS n, round(avg(em) * 100, 4) AS exact_match, round(avg(f1) * 100, 4) AS f1 FROM sc"
    out["masked_accuracy"] = """SELECT count(*) AS n, round(avg((quality = toxic)::INT), 4) AS accuracy FROM labels JOIN documents USING (doc_id) WHERE lang <> 'de'"""
    out["perplexity"] = "SELECT round(exp(avg(value / 10)), 4) AS perplexity FROM events"
    own = "SELECT batch, item, p AS v, true AS own FROM pairs"
    out["in_batch_nll"] = batch_loss(own)
    out["in_batch_nll_hard"] = batch_loss(f"{own} UNION ALL SELECT batch, item, hard, false FROM pairs")
    out["best_so_far"] = """WITH d AS (SELECT event_type AS metric, date_diff('day', DATE '1970-01-01', ts::DATE) AS epoch, avg(value) AS value FROM events GROUP BY ALL),
b AS (SELECT *, greatest(0.0, coalesce(max(value) OVER (PARTITION BY metric ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS earlier FROM d)
SELECT metric, epoch, round(value, 4) AS value, round(earlier, 4) AS earlier_best FROM b WHERE value > earlier"""

    # Training data.
    passages_as_questions = "SELECT id AS qid, gold_text AS question FROM ex"
    index, rest = bm25(passages_as_questions, 4).split(",\nq AS", 1)
    out["hard_negatives"] = f"""WITH {index}, {GOLD}, {GOLD_EXAMPLES},
q AS{rest},
neg AS (SELECT h.qid, c.text, row_number() OVER (PARTITION BY h.qid ORDER BY h.rank) AS r FROM hits h JOIN corpus c USING (doc_id) JOIN q ON q.qid = h.qid
  WHERE regexp_replace(c.text, '{breaks}', '', 'g') <> regexp_replace(q.question, '{breaks}', '', 'g'))
SELECT e.id, """ + ", ".join(f"md5(coalesce(max(CASE WHEN r = {i} THEN text END), 'None')) AS top{i}_md5" for i in (1, 2, 3)) + """
  FROM ex e LEFT JOIN neg ON neg.qid = e.id GROUP BY e.id"""
    out["chunk_windows"] = f"""WITH {WINDOWS} SELECT id, chunk, context_start, token_start, count(*) AS n_tokens, arg_min(s, i) AS first_char, arg_max(e, i) AS last_char,
  md5(string_agg(t, ' ' ORDER BY i)) AS tokens_md5 FROM wtok GROUP BY id, chunk, context_start, token_start"""
    out["align_answer"] = f"""WITH {WINDOWS}, {ANSWERS},
edge AS (SELECT id, chunk, min(s) AS lo, max(e) AS hi, max(context_start) AS cs FROM wtok GROUP BY id, chunk),
f AS (SELECT edge.id, edge.chunk, coalesce(lo <= a AND hi >= a + w, false) AS inside, a, w FROM edge LEFT JOIN ans ON ans.id = edge.id)
SELECT f.id, f.chunk, CASE WHEN any_value(inside) THEN max(CASE WHEN s <= a THEN p END) ELSE 0 END::BIGINT AS start_position,
  CASE WHEN any_value(inside) THEN min(CASE WHEN e >= a + f.w THEN p END) ELSE 0 END::BIGINT AS end_position
  FROM f JOIN wtok ON wtok.id = f.id AND wtok.chunk = f.chunk GROUP BY f.id, f.chunk"""
    out["align_answer_words"] = f"""{WORD_WINDOWS[:WORD_WINDOWS.index("SELECT o.id")].rstrip()}, {ANSWERS},
tok AS (SELECT o.id, w.chunk, 383 - w.cap + i - w.chunk * (w.cap - 128) AS p, e - length(t) AS s, e
  FROM o JOIN w ON o.id = w.id AND i >= w.chunk * (w.cap - 128) AND i < w.chunk * (w.cap - 128) + w.cap),
edge AS (SELECT id, chunk, min(s) AS lo, max(e) AS hi FROM tok GROUP BY id, chunk),
f AS (SELECT edge.id, edge.chunk, coalesce(lo <= a AND hi >= a + w, false) AS inside, a, w FROM edge LEFT JOIN ans ON ans.id = edge.id)
SELECT f.id, f.chunk, CASE WHEN any_value(inside) THEN max(CASE WHEN s <= a THEN p END) ELSE 0 END::BIGINT AS start_position,
  CASE WHEN any_value(inside) THEN min(CASE WHEN e >= a + f.w THEN p END) ELSE 0 END::BIGINT AS end_position
  FROM f JOIN tok ON tok.id = f.id AND tok.chunk = f.chunk GROUP BY f.id, f.chunk"""
    out["inference_features"] = f"""WITH {WINDOWS} SELECT id, chunk, 384::BIGINT AS n_positions, count(*) AS n_inside, sum(s + e)::BIGINT AS offset_sum FROM wtok GROUP BY id, chunk"""
    out["mlm_lines"] = f"""SELECT doc_id, line_no, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5
  FROM (SELECT doc_id, line_no, string_split(text, ' ')[1:512] AS t FROM {lines} WHERE {not_blank})"""
    out["pack_blocks"] = f"""WITH {CORPUS}, p AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM corpus),
t AS (SELECT position // 1000 AS batch, position, unnest(string_split(text, ' ')) AS t, generate_subscripts(string_split(text, ' '), 1) AS i FROM p),
n AS (SELECT batch, t, row_number() OVER (PARTITION BY batch ORDER BY position, i) - 1 AS place, count(*) OVER (PARTITION BY batch) AS total FROM t)
SELECT batch, place // 512 AS block_id, count(*) AS n_tokens, md5(string_agg(t, ' ' ORDER BY place)) AS tokens_md5 FROM n
  WHERE place // 512 < total // 512 OR total < 512 GROUP BY ALL"""
    number = "('0x' || substr(h, {at}, 8))::BIGINT"
    out["mask_tokens"] = f"""WITH t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS t, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM documents),
d AS (SELECT doc_id, i, ('0x' || substr(md5(t), 1, 8))::BIGINT % 31995 + 5 AS tok, md5(doc_id || ':' || i || ':42') AS h FROM t),
c AS (SELECT doc_id, i, tok, {number.format(at=1)} < 644245094 AS chosen, {number.format(at=9)} % 10 AS act, {number.format(at=17)} % 32000 AS rnd FROM d),
m AS (SELECT doc_id, i, chosen, CASE WHEN chosen THEN CASE WHEN act < 8 THEN 4 WHEN act = 8 THEN rnd ELSE tok END ELSE tok END AS x, CASE WHEN chosen THEN tok ELSE -100 END AS l FROM c)
SELECT doc_id, count_if(chosen)::BIGINT AS n_chosen, md5(string_agg(x, ' ' ORDER BY i)) AS input_md5, md5(string_agg(l, ' ' ORDER BY i)) AS labels_md5 FROM m GROUP BY doc_id"""
    out["training_batches"] = """WITH o AS (SELECT doc_id AS id, row_number() OVER (ORDER BY ('0x' || substr(md5(doc_id || ':42'), 1, 8))::BIGINT, doc_id) - 1 AS position FROM documents)
SELECT id, position // 32 AS batch, position FROM o WHERE position // 32 < (SELECT count(*) FROM documents) // 32"""

    # Answer spans.
    out["top_positions"] = f"""WITH {LOGITS} SELECT id, chunk, 'start' AS side, sr AS rank, p AS pos, sl AS logit FROM ord WHERE sr <= 20
UNION ALL SELECT id, chunk, 'end', er, p, el FROM ord WHERE er <= 20"""
    out["span_pairs"] = f"WITH {PAIRS} SELECT id, chunk, round(score, 4) AS score, start_rank, end_rank, start_pos, end_pos, s, e FROM pairs"
    out["null_score"] = f"WITH {LOGITS}, {NULLS} SELECT id, round(null_score, 4) AS null_score FROM nul"
    out["span_nbest"] = f"WITH {NBEST} SELECT id, rank, md5(text) AS text_md5, round(sl, 4)::DOUBLE AS start_logit, round(el, 4)::DOUBLE AS end_logit FROM nbest"
    out["nbest_softmax"] = f"WITH {NBEST} SELECT id, rank, round(probability, 4) AS probability FROM nbest"
    out["best_answer"] = f"WITH {NBEST} SELECT id, md5(text) AS text_md5 FROM nbest WHERE rank = 1"
    out["best_answer_null"] = f"""WITH {NBEST_NULL} SELECT id, md5(CASE WHEN null_score - sl - el > 0 THEN '' ELSE text END) AS text_md5, round(null_score - sl - el, 4)::DOUBLE AS score_diff FROM pick"""

    # Prediction sets.
    out["agreement"] = f"WITH {MODELS} SELECT count(*) AS n, round(avg((base_text = partner_text)::INT), 4) AS agreement FROM tab"
    out["differences"] = f"WITH {MODELS} SELECT id FROM tab WHERE base_text <> challenger_text"
    out["diff_intersect"] = f"WITH {MODELS} SELECT id FROM tab WHERE base_text <> partner_text AND base_text <> challenger_text AND base_text <> fourth_text"
    out["diff_union"] = f"WITH {MODELS} SELECT id FROM tab WHERE base_text <> partner_text OR base_text <> challenger_text OR base_text <> fourth_text"
    out["side_by_side"] = f"""WITH {MODELS} SELECT id, base_text AS base, partner_text AS partner, challenger_text AS challenger, fourth_text AS fourth FROM tab WHERE base_text <> challenger_text"""
    out["max_probability"] = f"WITH {MODELS} SELECT id, round(base_p, 4) AS probability FROM tab"
    out["confidence_summary"] = f"""WITH {MODELS} SELECT count(*) AS n, round(avg(base_p), 4) AS mean_p, round(min(base_p), 4) AS min_p, round(max(base_p), 4) AS max_p,
  count_if(base_p < 0.35)::BIGINT AS below_35, count_if(base_p < 0.5)::BIGINT AS below_50, count_if(base_p < 0.7)::BIGINT AS below_70 FROM tab"""
    out["pair_confidence"] = f"WITH {MODELS} SELECT id, round((base_p + partner_p) / 2, 4) AS probability FROM tab"
    out["ensemble_rules"] = f"WITH {RULED} SELECT id, rule1::BIGINT AS rule1, rule2::BIGINT AS rule2, rule3::BIGINT AS rule3 FROM ruled"
    out["ensemble_flags"] = f"""WITH {MODELS} SELECT id, (base_p + 0.4 <= fourth_p AND base_text <> fourth_text)::BIGINT AS rule4,
  (base_p + 0.4 <= fifth_p AND base_text <> fifth_text)::BIGINT AS rule5 FROM tab"""
    out["ensemble_apply"] = f"WITH {RULED} SELECT id, CASE WHEN rule1 OR rule2 OR rule3 THEN challenger_text ELSE base_text END AS text FROM ruled"

    # Profiling.
    out["corpus_counts"] = "SELECT count(text) AS n_raw, count(DISTINCT text) AS n_distinct FROM documents"
    stats = "SELECT count(*) AS n, max(len) AS longest, min(len) AS shortest, round(avg(len), 4) AS mean_length FROM (SELECT {0} AS len FROM documents)"
    out["length_stats"] = stats.format("length(text)")
    out["token_length_stats"] = stats.format("len(string_split(text, ' '))")
    out["length_histogram"] = """WITH l AS (SELECT length(text) AS len FROM documents), b AS (SELECT min(len) AS lo, max(len) AS hi FROM l),
c AS (SELECT CASE WHEN lo = hi THEN 5 ELSE least(9, floor((len - lo) * 10 / (hi - lo)))::BIGINT END AS bin, count(*) AS n FROM l, b GROUP BY 1)
SELECT r.bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(10)) AS bin) r LEFT JOIN c ON c.bin = r.bin"""
    out["length_threshold"] = """SELECT count_if(length(text) >= 750)::BIGINT AS n_long, 'char' AS unit FROM documents
UNION ALL SELECT count_if(len(string_split(text, ' ')) >= 401)::BIGINT, 'token' FROM documents"""
    return out
