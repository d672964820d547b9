"""DuckDB statements for the queries of the subpackage that SQL can express."""

from __future__ import annotations

from lectern.llm.quality import RULES, STOP_WORDS

WORD = r"[^\x20\x09-\x0D]+"


def quality_rules() -> str:
    """The counts, the base rule and the threshold table of the quality rules."""
    ratios = {
        "n_words": "n_words",
        "mean_word_chars": "coalesce(word_chars / nullif(n_words, 0), 0)",
        "symbol_ratio": "coalesce(n_symbols / nullif(n_words, 0), 0)",
        "stop_ratio": "coalesce(n_stop / nullif(n_words, 0), 0)",
        "dup_line_ratio": "coalesce(n_dup_lines / nullif(n_lines, 0), 0)",
        "bullet_line_ratio": "coalesce(n_bullet / nullif(n_lines, 0), 0)",
        "ellipsis_line_ratio": "coalesce(n_ellipsis / nullif(n_lines, 0), 0)",
    }
    rules = " AND ".join(f"{ratios[r.measure]} BETWEEN {r.low} AND {r.high}" for r in RULES)
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    return rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), word_rows AS (
  SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM base
), grams AS (
  SELECT doc_id, i, word || ' ' || lead(word, 1) OVER d || ' ' || lead(word, 2) OVER d AS gram
  FROM word_rows WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM grams WHERE gram IS NOT NULL)
  WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, (VALUES (0), (1), (2)) AS offsets(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM base
), line_counts AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
    count(*) FILTER (regexp_matches(line, '^[\x20\x09]*[-*•‣·]')) AS n_bullet,
    count(*) FILTER (regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*$')) AS n_ellipsis
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), counts AS (
  SELECT b.doc_id, len(b.w)::BIGINT AS n_words, coalesce(list_sum(list_transform(b.w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    len(list_filter(b.w, lambda x: lower(x) IN ({stops}))) AS n_stop,
    coalesce(l.n_lines, 0) AS n_lines, coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(l.n_bullet, 0) AS n_bullet, coalesce(l.n_ellipsis, 0) AS n_ellipsis,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM base b LEFT JOIN line_counts l USING (doc_id) LEFT JOIN covered c USING (doc_id)
), verdict AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {rules} AS passed FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND passed AS kept
FROM verdict
"""


def near_dedup(shingle: int = 2) -> str:
    """Components of documents whose sets of two-word shingles are alike."""
    if shingle != 2:
        raise ValueError("the statement is for two-word shingles")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{WORD}') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN sizes nx ON nx.doc_id = x JOIN sizes ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)
), ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, w.y FROM reach r JOIN ways w ON w.x = r.other
)
SELECT r.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id, min(other) = r.doc_id AS kept
FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""


def warc() -> str:
    """What a round trip through archives must give back."""
    return """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT h, max(page_id) AS r FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, strlen(p.h)::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN r <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN r <> page_id THEN r END AS refers_to, true AS verified
FROM p LEFT JOIN m ON m.h = p.h
"""


def clustering(k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64) -> str:
    """Rounds of assignment and new centroids, one pair of expressions for each."""
    parts = [f"""vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda v: floor(1024 * v::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda v: isfinite(v))) = {dim}
), centroids0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM vectors ORDER BY h LIMIT {k})
)"""]
    for r in range(rounds + 1):
        parts.append(f"""assigned{r} AS MATERIALIZED (
  SELECT row, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM (
    SELECT row, c, list_sum(list_transform(list_zip(v.x, m.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
    FROM vectors v, centroids{r} m
  ) GROUP BY row
)""")
        if r < rounds:
            parts.append(f"""centroids{r + 1} AS MATERIALIZED (
  SELECT m.c, coalesce(n.x, m.x) AS x FROM centroids{r} m LEFT JOIN (
    SELECT c, list((s - (s % n + n) % n) // n ORDER BY i) AS x FROM (
      SELECT c, i, sum(v)::BIGINT AS s, count(*) AS n
      FROM (SELECT a.c, generate_subscripts(x, 1) AS i, unnest(x) AS v FROM vectors JOIN assigned{r} a USING (row)) GROUP BY c, i
    ) GROUP BY c
  ) n USING (c)
)""")
    return "WITH " + ", ".join(parts) + f"""
SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m.x, ',')) AS centroid_sha256
FROM vectors JOIN assigned{rounds} a USING (row) JOIN centroids{rounds} m USING (c)
"""


def resampling(buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024) -> str:
    """Features of single words; the CRC of each distinct word is worked out byte by byte."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    shift = "b"
    for _ in range(8):
        shift = f"list_transform({shift}, lambda c: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return rf"""
WITH steps AS MATERIALIZED (
  SELECT {shift} AS t FROM (SELECT range(0, 256) AS b)
), words AS MATERIALIZED (
  SELECT row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)
), aimed AS MATERIALIZED (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), source_words AS MATERIALIZED (
  SELECT row, unnest(w) AS word FROM words
), hashed AS MATERIALIZED (
  SELECT word, xor(list_reduce(
    list_concat([4294967295], list_transform(range(0, octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)),
    lambda crc, b: xor(crc >> 8, t[xor(crc & 255, b) + 1])
  ), 4294967295) % {buckets} AS bucket
  FROM (SELECT word FROM source_words UNION SELECT word FROM aimed), steps
), s AS MATERIALIZED (
  SELECT bucket, count(*) AS n FROM source_words JOIN hashed USING (word) GROUP BY bucket
), t AS MATERIALIZED (
  SELECT bucket, count(*) AS n FROM aimed JOIN hashed USING (word) GROUP BY bucket
), totals AS (
  SELECT (SELECT count(*) FROM source_words)::DOUBLE AS s, (SELECT count(*) FROM aimed)::DOUBLE AS t
), gains AS MATERIALIZED (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * (totals.s + {buckets}) / ((s.n + 1.0::DOUBLE) * (totals.t + {buckets}))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), totals
), weights AS (
  SELECT row, sum(gain)::BIGINT AS weight FROM source_words JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY row
), scored AS (
  SELECT row, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (row)
), placed AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= {min_words}
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {percent} * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (row)
"""


def statements() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules(),
        "op3_minhash_near_dedup": near_dedup(),
        "op7_warc": warc(),
        "op12_centroid_clustering": clustering(),
        "op13_target_resampling": resampling(),
    }
