"""The same queries in SQL, stated independently as plain windows and recursions."""

from __future__ import annotations

from gristmill.plans import settings as S

# Python's white space, and Unicode white space as the split pattern means it.
SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
UNICODE_SPACE = r"\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# This engine's patterns have no look-ahead. A private-use mark goes before each space that
# a non-space follows; the piece pattern then stops at marks and drops them.
MARK = r"\x{e000}"
PIECES = (
    rf"''(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{UNICODE_SPACE}\p{{L}}\p{{N}}{MARK}]+"
    rf"|[{UNICODE_SPACE}]+"
)


def words(text: str) -> str:
    return f"len(regexp_extract_all({text}, '[^{SPACE}]+'))"


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '\A[{SPACE}]+|[{SPACE}]+\z', '', 'g')"


def pieces(text: str) -> str:
    marked = rf"regexp_replace({text}, '([{UNICODE_SPACE}])([^{UNICODE_SPACE}])', chr(57344) || '\1\2', 'g')"
    return f"regexp_extract_all({marked}, '{PIECES}')"


def hashed(key: str) -> str:
    return f"md5('{S.SEED}:' || {key})"


def with_(*steps: str, recursive: bool = False) -> str:
    *ctes, body = steps
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + body


ORACLE: dict[str, str] = {}

# --- documents --------------------------------------------------------------------------

KEPT = f"""kept AS MATERIALIZED (
  SELECT doc_id, text, {words('text')} AS words FROM documents
  WHERE length(coalesce(text, '')) BETWEEN {S.SHORTEST} AND {S.LONGEST})"""


def budget(target: float) -> str:
    return f"""budget AS MATERIALIZED (
  SELECT * FROM (
    SELECT *, sum(words) OVER (ORDER BY doc_id) - words AS ahead FROM kept)
  WHERE ahead < {target} * 0.74)"""


BUDGET = budget(S.BUDGET_TOKENS)
WHOLE = budget(S.TARGET_TOKENS)
SHARDED = f"""sharded AS MATERIALIZED (
  SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // {S.RAW_SHARD_ROWS} AS shard FROM kept)"""
BUDGET_SHARDED = f"""budget_sharded AS MATERIALIZED (
  SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // {S.RAW_SHARD_ROWS} AS shard FROM budget)"""


def manifest_of(source: str) -> str:
    return f"""SELECT shard, count(*) AS num_rows, CAST(floor(sum(words) / 0.74) AS BIGINT) AS est_tokens,
  CAST(sum(length(text)) AS BIGINT) AS text_chars,
  CAST(sum(octet_length(encode(text))) AS BIGINT) AS text_bytes
FROM {source} GROUP BY shard"""


ORACLE["scan_documents"] = """
SELECT doc_id, text, source AS url, coalesce(CAST(quality AS DOUBLE), 0.0) AS score
FROM documents LEFT JOIN labels USING (doc_id)"""
ORACLE["scan_pages"] = "SELECT page_id AS doc_id, html AS text, url, CAST(0.0 AS DOUBLE) AS score FROM pages"
ORACLE["stream_documents"] = "SELECT doc_id, text, source AS url FROM documents"
ORACLE["peek_documents"] = f"""
SELECT doc_id, source AS url, CAST(0.0 AS DOUBLE) AS score, length(text) AS chars,
  {words('text')} AS words, {words('text')} / 0.74::DOUBLE AS est_tokens,
  {strip('substr(text, 1, 200)')} AS preview
FROM documents ORDER BY doc_id LIMIT 3"""
ORACLE["size_estimate"] = f"""
WITH seen AS (
  SELECT sum({words('text')}) / 0.74::DOUBLE / count(*) AS mean_tokens
  FROM (SELECT text FROM documents ORDER BY doc_id LIMIT 3)),
docs AS (SELECT *, CAST(floor({S.BUDGET_TOKENS} / mean_tokens) AS BIGINT) AS docs_needed FROM seen)
SELECT mean_tokens, docs_needed,
  CAST(ceil(docs_needed / {S.RAW_SHARD_ROWS}) AS BIGINT) AS shards_needed,
  {S.BUDGET_TOKENS}::DOUBLE / 10000000000::DOUBLE AS sample_share,
  {S.BUDGET_TOKENS}::DOUBLE / 10000000000::DOUBLE * 28::DOUBLE AS compressed_gb,
  {S.BUDGET_TOKENS}::DOUBLE / 10000000000::DOUBLE * 75::DOUBLE AS raw_gb,
  {S.BUDGET_TOKENS}::DOUBLE / 10000000000::DOUBLE * 28::DOUBLE * 1.15::DOUBLE AS disk_gb
FROM docs"""
ORACLE["write_raw_shards"] = with_(
    KEPT,
    SHARDED,
    """SELECT shard, count(*) AS num_rows, CAST(sum(length(text)) AS BIGINT) AS text_chars,
  1::BIGINT AS files FROM sharded GROUP BY shard""",
)
ORACLE["read_manifest"] = with_(
    KEPT, SHARDED, f"SELECT shard, num_rows, est_tokens FROM ({manifest_of('sharded')})"
)
ORACLE["verify_checksums"] = with_(
    KEPT, SHARDED, 'SELECT DISTINCT shard, true AS present, shard <> 0 AS "match" FROM sharded'
)
ORACLE["filter_length"] = f"""
SELECT doc_id, text FROM documents
WHERE length(coalesce(text, '')) BETWEEN {S.SHORTEST} AND {S.SHARP_LONGEST}"""
ORACLE["filter_counts"] = f"""
SELECT count(*) FILTER (length(text) BETWEEN {S.SHORTEST} AND {S.SHARP_LONGEST}) AS kept,
  count(*) FILTER (coalesce(length(text), 0) < {S.SHORTEST}) AS too_short,
  count(*) FILTER (length(text) > {S.SHARP_LONGEST}) AS too_long FROM documents"""
ORACLE["drop_tiny"] = "SELECT doc_id, text FROM documents WHERE length(text) >= 10"
ORACLE["word_count"] = f"SELECT doc_id, {words('text')} AS words FROM documents"
ORACLE["token_estimate"] = f"""
SELECT doc_id, {words('text')} AS words, {words('text')} / 0.74::DOUBLE AS est_tokens FROM documents"""
ORACLE["take_until_budget"] = with_(KEPT, BUDGET, "SELECT doc_id, text FROM budget")
ORACLE["shard_by_rows"] = with_(KEPT, SHARDED, "SELECT doc_id, shard, text FROM sharded")
ORACLE["shard_manifest"] = with_(KEPT, WHOLE, BUDGET_SHARDED, manifest_of("budget_sharded"))
ORACLE["manifest_totals"] = with_(
    KEPT,
    WHOLE,
    BUDGET_SHARDED,
    f"""SELECT count(*) AS shards, CAST(sum(num_rows) AS BIGINT) AS num_rows,
  CAST(sum(est_tokens) AS BIGINT) AS est_tokens, CAST(sum(text_bytes) AS BIGINT) AS text_bytes
FROM ({manifest_of('budget_sharded')})""",
)
ORACLE["resume_ingest"] = with_(
    KEPT,
    BUDGET,
    BUDGET_SHARDED,
    f"""SELECT doc_id, (SELECT max(shard) + 1 FROM budget_sharded)
  + (row_number() OVER (ORDER BY doc_id) - 1) // {S.RAW_SHARD_ROWS} AS shard
FROM kept WHERE doc_id NOT IN (SELECT doc_id FROM budget)""",
)
ORACLE["incremental_ingest"] = with_(
    KEPT,
    BUDGET,
    BUDGET_SHARDED,
    f"""later AS (SELECT *, (SELECT max(shard) + 1 FROM budget_sharded)
    + (row_number() OVER (ORDER BY doc_id) - 1) // {S.RAW_SHARD_ROWS} AS shard
  FROM kept WHERE doc_id NOT IN (SELECT doc_id FROM budget))""",
    """SELECT shard, count(*) AS num_rows, CAST(sum(words) AS BIGINT) AS words, max(doc_id) AS last_doc
FROM (SELECT shard, words, doc_id FROM budget_sharded UNION ALL SELECT shard, words, doc_id FROM later)
GROUP BY shard""",
)
ORACLE["run_stats"] = with_(
    KEPT,
    WHOLE,
    f"""read AS (SELECT *, length(text) BETWEEN {S.SHORTEST} AND {S.LONGEST} AS ok FROM documents
  WHERE doc_id <= (SELECT max(doc_id) FROM budget))""",
    f"""SELECT CAST(ceil(count(*) FILTER (ok) / {S.RAW_SHARD_ROWS}) AS BIGINT) AS total_shards,
  count(*) FILTER (ok) AS total_docs,
  CAST(floor(sum({words('text')}) FILTER (ok) / 0.74) AS BIGINT) AS total_tokens_est,
  CAST(sum(length(text)) FILTER (ok) AS BIGINT) AS text_chars,
  CAST(sum(octet_length(encode(text))) FILTER (ok) AS BIGINT) AS text_bytes,
  count(*) FILTER (length(text) < {S.SHORTEST}) AS skipped_short,
  count(*) FILTER (length(text) > {S.LONGEST}) AS skipped_long,
  'documents' AS dataset, {S.TARGET_TOKENS}::BIGINT AS target_tokens FROM read""",
)
ORACLE["ingest_progress"] = """
WITH log AS (
  SELECT strftime(ts, '%Y-%m-%d') AS batch, count(*) AS docs,
    (epoch_us(max(ts)) - (SELECT epoch_us(min(ts)) FROM events)) / 1e6::DOUBLE AS elapsed_s
  FROM events GROUP BY 1),
total AS (SELECT *, CAST(sum(docs) OVER (ORDER BY elapsed_s, batch) AS BIGINT) AS total_docs FROM log)
SELECT batch, total_docs, round(total_docs / elapsed_s + 1e-9::DOUBLE, 6) AS docs_per_s,
  round((1000000 - total_docs) / greatest(total_docs / elapsed_s, 1.0::DOUBLE) / 60 + 1e-9::DOUBLE, 6) AS eta_min
FROM total"""
for name, verb in (("missing_shards", "NOT IN"), ("present_shards", "IN")):
    ORACLE[name] = with_(
        KEPT,
        BUDGET,
        SHARDED,
        BUDGET_SHARDED,
        f"""SELECT shard, num_rows, est_tokens FROM ({manifest_of('sharded')})
WHERE shard {verb} (SELECT shard FROM budget_sharded)""",
    )

# --- splits -----------------------------------------------------------------------------

SPLIT = f"""split_docs AS MATERIALIZED (
  SELECT *, CASE WHEN shard > (SELECT max(shard) FROM sharded)
      - greatest(1, CAST(floor((SELECT max(shard) + 1 FROM sharded) * {S.VAL_SHARD_SHARE}::DOUBLE) AS BIGINT))
    THEN 'val' ELSE 'train' END AS split FROM sharded)"""
ORACLE["split_by_shard"] = with_(KEPT, SHARDED, SPLIT, "SELECT doc_id, shard, split FROM split_docs")
ORACLE["seeded_shuffle"] = f"""
SELECT doc_id, row_number() OVER (ORDER BY {hashed('doc_id')}, doc_id) - 1 AS position FROM documents"""

# --- conversations ----------------------------------------------------------------------

CLEAN = f"""clean AS MATERIALIZED (
  SELECT conv_id, turn,
    CASE WHEN {strip("coalesce(role, '')")} IN ('human', 'user') THEN 'Human'
      WHEN {strip("coalesce(role, '')")} IN ('gpt', 'assistant') THEN 'Assistant' END AS speaker,
    {strip("coalesce(text, '')")} AS value FROM conversations)"""


def verdicts(least: int = 2, reply: int = S.MIN_REPLY) -> str:
    return f"""verdicts AS MATERIALIZED (
  SELECT conv_id, count(*) >= {least}
      AND count(*) FILTER (speaker IS NOT NULL AND value <> '') >= {least} AS long_enough,
    count(*) FILTER (speaker = 'Assistant' AND value <> '' AND length(value) < {reply}) > 0 AS short_reply
  FROM clean GROUP BY conv_id)"""


KEPT_CHATS = "kept_chats AS MATERIALIZED (SELECT conv_id FROM verdicts WHERE long_enough AND NOT short_reply)"
PARTS = """parts AS MATERIALIZED (
  SELECT conv_id, turn, CASE WHEN speaker = 'Human' THEN '### Human: ' || value || chr(10)
    ELSE '### Assistant: ' || value || '<|endoftext|>' || chr(10) END AS part
  FROM clean SEMI JOIN kept_chats USING (conv_id) WHERE speaker IS NOT NULL AND value <> '')"""
RENDERED = """rendered AS MATERIALIZED (
  SELECT conv_id, string_agg(part, '' ORDER BY turn) AS text FROM parts GROUP BY conv_id)"""
CHATS = (CLEAN, verdicts(), KEPT_CHATS, PARTS)

ORACLE["group_turns"] = """
SELECT conv_id, count(*) AS turns, string_agg(role || ':' || md5(text), ',' ORDER BY turn) AS contents
FROM conversations GROUP BY conv_id"""
ORACLE["normalize_roles"] = with_(CLEAN, "SELECT * FROM clean WHERE speaker IS NOT NULL")
ORACLE["drop_empty_turns"] = with_(CLEAN, "SELECT * FROM clean WHERE value <> ''")
ORACLE["reject_short_reply"] = with_(
    CLEAN,
    verdicts(reply=S.SHARP_REPLY),
    """SELECT conv_id, turn, role, text FROM conversations
WHERE conv_id IN (SELECT conv_id FROM verdicts WHERE NOT short_reply)""",
)
ORACLE["min_turns"] = with_(
    CLEAN,
    verdicts(4),
    """SELECT conv_id, turn, role, text FROM conversations
WHERE conv_id IN (SELECT conv_id FROM verdicts WHERE long_enough)""",
)
ORACLE["render_chat"] = with_(*CHATS, RENDERED, "SELECT conv_id, text FROM rendered")
ORACLE["format_counts"] = with_(
    CLEAN,
    verdicts(reply=S.SHARP_REPLY),
    """SELECT count(*) FILTER (long_enough AND NOT short_reply) AS kept,
  count(*) FILTER (NOT (long_enough AND NOT short_reply)) AS skipped FROM verdicts""",
)


def capped(most: int) -> str:
    return f"""capped AS MATERIALIZED (
  SELECT conv_id, ok FROM (
    SELECT *, sum(ok::INT) OVER (ORDER BY conv_id) - ok::INT AS ahead
    FROM (SELECT conv_id, long_enough AND NOT short_reply AS ok FROM verdicts))
  WHERE ahead < {most})"""


CAPPED = capped(S.MOST_SAMPLES)
ORACLE["cap_samples"] = with_(
    CLEAN,
    verdicts(),
    capped(S.CAP_SAMPLES),
    "SELECT count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok) AS skipped FROM capped",
)
ORACLE["build_prompt"] = with_(
    CLEAN,
    """SELECT conv_id, turn, '### Human: ' || value || chr(10) || '### Assistant:' AS prompt
FROM clean WHERE speaker = 'Human'""",
)
ORACLE["extract_answer"] = with_(
    *CHATS,
    RENDERED,
    f"""SELECT conv_id, {strip("split_part(split_part(text, '### Assistant:', -1), '<|endoftext|>', 1)")} AS answer
FROM rendered""",
)
ORACLE["extract_question"] = with_(
    *CHATS,
    RENDERED,
    f"""SELECT conv_id,
  {strip("split_part(nullif(split_part(text, '### Human:', 2), ''), chr(10), 1)")} AS question FROM rendered""",
)
CHAT_SPLIT = f"""chat_split AS MATERIALIZED (
  SELECT conv_id, {hashed('conv_id')} AS shuffle, CASE WHEN row_number() OVER (ORDER BY {hashed('conv_id')}, conv_id)
    <= greatest({S.MIN_VAL_SAMPLES}, (SELECT CAST(floor(count(*) * {S.VAL_SAMPLE_SHARE}::DOUBLE) AS BIGINT) FROM capped WHERE ok))
    THEN 'val' ELSE 'train' END AS split
  FROM capped WHERE ok)"""
ORACLE["split_head"] = with_(CLEAN, verdicts(), CAPPED, CHAT_SPLIT, "SELECT conv_id, split FROM chat_split")

# --- tokens -----------------------------------------------------------------------------

MOST_PIECES = S.VOCAB_SIZE - 257
EOT = S.VOCAB_SIZE - 1
VOCAB = f"""piece_counts AS (
  SELECT piece, count(*) AS n FROM (
    SELECT unnest({pieces('text')}) AS piece FROM documents WHERE length(text) >= 10) GROUP BY piece),
vocab AS MATERIALIZED (
  SELECT 255 + row_number() OVER (ORDER BY n DESC, piece) AS token, piece, n FROM piece_counts
  ORDER BY n DESC, piece LIMIT {MOST_PIECES})"""


def encoded(name: str, source: str, keys: str, segments: str) -> str:
    """Ids of ``segments``, a query giving keys, segment number, text, closing flag."""
    return f"""{name}_cut AS MATERIALIZED (
  SELECT {keys}, segment, unnest(cut) AS piece, generate_subscripts(cut, 1) AS place
  FROM (SELECT {keys}, segment, {pieces('text')} AS cut FROM ({segments}))),
{name} AS MATERIALIZED (
  SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY segment, place, sub) - 1 AS pos, token FROM (
    SELECT {keys}, segment, place, 0 AS sub, token FROM {name}_cut JOIN vocab USING (piece)
    UNION ALL
    SELECT {keys}, segment, place, sub, CAST('0x' || substr(hex(encode(piece)), 2 * sub + 1, 2) AS BIGINT) AS token
    FROM (SELECT *, unnest(range(octet_length(encode(piece)))) AS sub FROM {name}_cut ANTI JOIN vocab USING (piece))
    UNION ALL
    {source}))"""


DOC_TOKENS = encoded(
    "doc_tokens",
    f"SELECT doc_id, 1 AS segment, 0 AS place, 0 AS sub, {EOT} AS token FROM documents WHERE length(text) >= 10",
    "doc_id",
    "SELECT doc_id, 0 AS segment, text FROM documents WHERE length(text) >= 10",
)
SEGMENTS = """SELECT conv_id, turn, unnest(split) AS text, generate_subscripts(split, 1) AS segment
  FROM (SELECT conv_id, turn, string_split(part, '<|endoftext|>') AS split FROM parts)"""
CHAT_TOKENS = encoded(
    "chat_tokens",
    f"SELECT conv_id, turn, segment, 0 AS place, 0 AS sub, {EOT} AS token FROM ({SEGMENTS}) WHERE segment > 1",
    "conv_id, turn",
    SEGMENTS,
)
ORACLE["pretokenize"] = f"""
SELECT doc_id, len(cut) AS n, array_to_string(cut, '|') AS pieces
FROM (SELECT doc_id, {pieces('text')} AS cut FROM documents)"""
ORACLE["build_vocab"] = with_(VOCAB, 'SELECT token, piece, n AS "count" FROM vocab')
ORACLE["encode_documents"] = with_(
    VOCAB,
    DOC_TOKENS,
    """SELECT doc_id, count(*) AS n_tokens, string_agg(token, ' ' ORDER BY pos) AS tokens
FROM doc_tokens GROUP BY doc_id""",
)
ORACLE["encode_samples"] = with_(
    VOCAB,
    *CHATS,
    CHAT_TOKENS,
    """SELECT conv_id, turn, count(*) AS n_tokens, string_agg(token, ' ' ORDER BY pos) AS tokens
FROM chat_tokens GROUP BY conv_id, turn""",
)
ORACLE["decode_tokens"] = (
    "SELECT doc_id, text || '<|endoftext|>' AS text FROM documents WHERE length(text) >= 10"
)
CHAT_STREAM = """chat_stream AS MATERIALIZED (
  SELECT split, row_number() OVER (PARTITION BY split ORDER BY shuffle, conv_id, turn, pos) - 1 AS pos, token
  FROM chat_tokens JOIN chat_split USING (conv_id))"""
STREAM_STEPS = (VOCAB, *CHATS, CAPPED, CHAT_SPLIT, CHAT_TOKENS, CHAT_STREAM)
ORACLE["concat_stream"] = with_(*STREAM_STEPS, "SELECT split, pos, token FROM chat_stream")
ORACLE["sample_windows"] = with_(
    *STREAM_STEPS,
    f"""starts AS (
  SELECT i AS "window", CAST('0x' || substr({hashed('i')}, 1, 12) AS BIGINT)
    % (n - {S.BLOCK}) AS first, split
  FROM range({S.WINDOWS}) t(i), (SELECT split, count(*) AS n FROM chat_stream GROUP BY split))""",
    f"""SELECT split, "window", first,
  string_agg(token, ' ' ORDER BY pos) FILTER (pos < first + {S.BLOCK}) AS x,
  string_agg(token, ' ' ORDER BY pos) FILTER (pos > first) AS y
FROM starts JOIN chat_stream USING (split) WHERE pos BETWEEN first AND first + {S.BLOCK}
GROUP BY split, "window", first""",
)
LENGTHS = """lengths AS MATERIALIZED (
  SELECT split, doc_id, n_tokens, row_number() OVER (PARTITION BY split ORDER BY doc_id) AS rn
  FROM split_docs JOIN (SELECT doc_id, count(*) AS n_tokens FROM doc_tokens GROUP BY doc_id) USING (doc_id))"""


def packed(name: str, lengths: str) -> str:
    return f"""{name} AS (
  SELECT split, doc_id, n_tokens, rn, 0::BIGINT AS shard, 0::BIGINT AS start FROM {lengths} WHERE rn = 1
  UNION ALL
  SELECT n.split, n.doc_id, n.n_tokens, n.rn,
    CASE WHEN p.start + p.n_tokens >= {S.TOKEN_SHARD} THEN p.shard + 1 ELSE p.shard END,
    CASE WHEN p.start + p.n_tokens >= {S.TOKEN_SHARD} THEN 0 ELSE p.start + p.n_tokens END
  FROM {name} p JOIN {lengths} n ON n.split = p.split AND n.rn = p.rn + 1)"""


PACK_STEPS = (VOCAB, DOC_TOKENS, KEPT, SHARDED, SPLIT, LENGTHS, packed("packed", "lengths"))
MANIFEST = """manifest AS MATERIALIZED (
  SELECT split, shard, count(*) AS docs, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM packed GROUP BY split, shard)"""


def on_packed(*steps: str) -> str:
    return with_(*PACK_STEPS, *steps, recursive=True)


ORACLE["pack_token_shards"] = on_packed("SELECT split, doc_id, shard, start, n_tokens FROM packed")
CAP = f"""cap AS MATERIALIZED (
  SELECT * FROM (SELECT *, sum(n_tokens) OVER (PARTITION BY split ORDER BY doc_id) - n_tokens AS ahead,
      sum(n_tokens) OVER (PARTITION BY split) >= {S.TOKEN_CAP} AS capped
    FROM lengths) WHERE ahead < {S.TOKEN_CAP})"""
ORACLE["cap_tokens"] = with_(
    *PACK_STEPS[:-1],
    CAP,
    "SELECT split, doc_id, n_tokens, capped FROM cap",
)


def hex_of(number: str, size: int) -> str:
    """Little-endian bytes of a number, as hex digits."""
    parts = ", ".join(f"({number} >> {8 * k}) & 255" for k in range(size))
    return f"printf('{'%02x' * size}', {parts})"


def hashed_files(source: str) -> str:
    """Bytes and checksum of each shard's file: header, zeros, ids."""
    head = " || ".join(hex_of(n, 4) for n in ("20240520", "1", "count(*)", str(S.VOCAB_SIZE)))
    ids = f"string_agg({hex_of('token', 2)}, '' ORDER BY start + pos)"
    return f"""{source}_files AS MATERIALIZED (
  SELECT split, shard, 1024 + 2 * count(*) AS file_bytes,
    md5(unhex({head} || repeat('00', 1008) || {ids})) AS md5
  FROM {source} JOIN doc_tokens USING (doc_id) GROUP BY split, shard)"""


ORACLE["token_manifest"] = on_packed(
    MANIFEST, hashed_files("packed"), "SELECT * FROM manifest JOIN packed_files USING (split, shard)"
)
ORACLE["capped_manifest"] = on_packed(
    CAP,
    packed("capped_pack", "cap"),
    hashed_files("capped_pack"),
    """SELECT split, shard, count(*) AS docs, CAST(sum(n_tokens) AS BIGINT) AS tokens, capped, file_bytes, md5
FROM capped_pack JOIN capped_pack_files USING (split, shard)
JOIN (SELECT DISTINCT split, capped FROM cap) USING (split) GROUP BY ALL""",
)
ORACLE["split_totals"] = on_packed(
    """SELECT split, count(DISTINCT shard) AS shards, count(*) AS docs, CAST(sum(n_tokens) AS BIGINT) AS tokens
FROM packed GROUP BY split"""
)
ORACLE["dataset_meta"] = on_packed(
    MANIFEST,
    hashed_files("packed"),
    f"""SELECT (SELECT 'train_09999: missing ' || tokens FROM manifest WHERE split = 'train' AND shard = 0) AS errors,
  (SELECT string_agg(split || '_00000: count ' || tokens, '; ' ORDER BY split) FROM manifest WHERE shard = 0) AS warnings,
  (SELECT md5(string_agg(md5, '' ORDER BY split, shard)) FROM packed_files) AS files,
  {S.VOCAB_SIZE}::BIGINT AS vocab_size, {EOT}::BIGINT AS eot_token,
  CAST(sum(n_tokens) AS BIGINT) AS total_tokens,
  CAST(sum(n_tokens) FILTER (split = 'train') AS BIGINT) AS train_total_tokens,
  count(*) FILTER (split = 'train') AS train_total_docs,
  count(DISTINCT shard) FILTER (split = 'train') AS train_n_shards,
  CAST(sum(n_tokens) FILTER (split = 'val') AS BIGINT) AS val_total_tokens,
  count(*) FILTER (split = 'val') AS val_total_docs,
  count(DISTINCT shard) FILTER (split = 'val') AS val_n_shards FROM packed"""
)
ORACLE["write_json_report"] = on_packed(
    f"""SELECT {S.VOCAB_SIZE} AS vocab_size, CAST(sum(n_tokens) AS BIGINT) AS total_tokens,
  count(DISTINCT shard) FILTER (split = 'train') AS train_shards,
  count(DISTINCT shard) FILTER (split = 'val') AS val_shards FROM packed"""
)
ORACLE["size_report"] = on_packed(
    """SELECT split, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(DISTINCT shard) AS shards,
  CAST(2 * sum(n_tokens) AS BIGINT) AS token_bytes,
  CAST(2 * sum(n_tokens) + 1024 * count(DISTINCT shard) AS BIGINT) AS file_bytes,
  2 * sum(n_tokens) / 1e6::DOUBLE AS mb,
  round(2 * sum(n_tokens) / (1024.0 * 1024.0)::DOUBLE + 1e-9::DOUBLE, 6) AS mib FROM packed GROUP BY split"""
)
ORACLE["export_token_shards"] = on_packed(
    MANIFEST,
    f"""SELECT split, shard, 20240520::BIGINT AS magic, 1::BIGINT AS version, tokens,
  {S.VOCAB_SIZE}::BIGINT AS vocab_size, 2 * tokens AS payload_bytes FROM manifest""",
)
ORACLE["import_token_shards"] = on_packed(
    """SELECT split, shard, count(*) AS tokens, CAST(sum(token) AS BIGINT) AS id_sum,
  CAST(max(token) AS BIGINT) AS max_token
FROM packed JOIN doc_tokens USING (doc_id) GROUP BY split, shard"""
)

# --- validation -------------------------------------------------------------------------

ORACLE["check_missing"] = on_packed(
    MANIFEST,
    CAP,
    packed("capped_pack", "cap"),
    """SELECT split, shard, 'error' AS level, 'missing' AS rule, CAST(tokens AS VARCHAR) AS detail
FROM manifest ANTI JOIN capped_pack USING (split, shard)""",
)
ORACLE["check_header"] = on_packed(
    MANIFEST,
    f"""SELECT split, shard, 'warning' AS level, 'vocab' AS rule, '{S.VOCAB_SIZE}' AS detail FROM manifest""",
)
ORACLE["check_size"] = on_packed(
    MANIFEST,
    """SELECT split, shard, 'error' AS level, 'size' AS rule, CAST(2 * tokens - 1024 AS VARCHAR) AS detail
FROM manifest""",
)
ORACLE["check_count"] = on_packed(
    MANIFEST,
    """SELECT split, shard, 'warning' AS level, 'count' AS rule, CAST(tokens AS VARCHAR) AS detail
FROM manifest WHERE shard = 0""",
)
ORACLE["check_range"] = on_packed(
    f"""SELECT split, shard, 'error' AS level, 'range' AS rule, CAST(max(token) AS VARCHAR) AS detail
FROM packed JOIN doc_tokens USING (doc_id) GROUP BY split, shard HAVING max(token) >= {EOT}"""
)
PLACED = """placed AS MATERIALIZED (
  SELECT split, shard, start + pos AS pos, token, doc_id, start, doc_tokens.pos AS doc_pos
  FROM packed JOIN doc_tokens USING (doc_id))"""
ORACLE["read_from"] = on_packed(
    PLACED,
    f"""SELECT split, shard, min(pos) AS first, count(*) AS tokens, CAST(sum(token) AS BIGINT) AS id_sum FROM placed
WHERE split = 'train' AND (shard > {S.CURSOR[0]} OR shard = {S.CURSOR[0]} AND pos >= {S.CURSOR[1]}) GROUP BY split, shard""",
)
ORACLE["read_windows"] = on_packed(
    MANIFEST,
    PLACED,
    f"""sized AS (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY shard) - 1 AS k, count(*) OVER (PARTITION BY split) AS n
  FROM manifest WHERE tokens > {S.BLOCK})""",
    f"""chosen AS (
  SELECT split, i AS "window", shard, ('0x' || substr(md5('{S.SEED}:' || i), 9, 8))::BIGINT % (tokens - {S.BLOCK}) AS first
  FROM sized, range({S.WINDOWS}) t(i) WHERE ('0x' || substr(md5('{S.SEED}:' || i), 1, 8))::BIGINT % n = k)""",
    f"""SELECT split, "window", shard, first, string_agg(token, ' ' ORDER BY pos) AS ids
FROM chosen JOIN placed USING (split, shard) WHERE pos BETWEEN first AND first + {S.BLOCK} GROUP BY ALL""",
)
ORACLE["check_start"] = on_packed(
    PLACED,
    f"""SELECT split, shard * 1000000 + pos // {S.BLOCK} AS shard, 'warning' AS level, 'start' AS rule,
  '{EOT}' AS detail FROM placed WHERE pos % {S.BLOCK} = 0 AND token = {EOT}
UNION ALL
SELECT DISTINCT split, shard, 'warning' AS level, 'start' AS rule, '{EOT}' AS detail FROM packed WHERE shard = 0""",
)
ORACLE["validation_report"] = on_packed(
    MANIFEST,
    "SELECT 0::BIGINT AS errors, 0::BIGINT AS warnings, count(*) > 0 AS passed FROM manifest",
)

# --- training blocks --------------------------------------------------------------------

SPAN = S.BATCH * S.BLOCK


def cut(name: str, source: str) -> str:
    """Batches of ``source`` (split, shard, pos, token)."""
    return f"""{name}_sizes AS (SELECT split, shard, (count(*) - 1) // {SPAN} AS batches FROM {source} GROUP BY split, shard),
{name}_ids AS (
  SELECT split, shard, pos, token, lead(token) OVER (PARTITION BY split, shard ORDER BY pos) AS following FROM {source}),
{name} AS MATERIALIZED (
  SELECT split, shard, pos // {SPAN} AS batch, pos % {SPAN} // {S.BLOCK} AS "row",
    string_agg(token, ' ' ORDER BY pos) AS x, string_agg(following, ' ' ORDER BY pos) AS y
  FROM {name}_ids JOIN {name}_sizes USING (split, shard) WHERE pos < batches * {SPAN}
  GROUP BY split, shard, pos // {SPAN}, pos % {SPAN} // {S.BLOCK})"""


ORACLE["split_token_totals"] = on_packed(
    """SELECT split, count(DISTINCT shard) AS shards, count(*) AS tokens
FROM packed JOIN doc_tokens USING (doc_id) GROUP BY split"""
)
ORACLE["cut_blocks"] = on_packed(
    PLACED, cut("blocks", "placed"), 'SELECT split, shard, batch, "row", x, y FROM blocks'
)
ORACLE["repeat_epochs"] = on_packed(
    PLACED,
    cut("blocks", "placed"),
    f"""SELECT split, shard, batch, "row", epoch, x, y
FROM blocks, (SELECT CAST(i AS INT) AS epoch FROM range({S.EPOCHS}) t(i))""",
)
ORACLE["resume_blocks"] = on_packed(
    PLACED,
    f"""rest AS MATERIALIZED (
  SELECT split, shard, CASE WHEN split = 'train' AND shard = {S.CURSOR[0]} THEN pos - {S.CURSOR[1]} ELSE pos END AS pos,
    token FROM placed
  WHERE split = 'val' OR shard > {S.CURSOR[0]} OR (shard = {S.CURSOR[0]} AND pos >= {S.CURSOR[1]}))""",
    cut("blocks", "rest"),
    'SELECT split, shard, batch, "row", x, y FROM blocks',
)
PAIRS = """pairs AS MATERIALIZED (
  SELECT * FROM (SELECT split, token, lead(token) OVER (PARTITION BY split, shard ORDER BY pos) AS next,
    lead(doc_id) OVER (PARTITION BY split, shard ORDER BY pos) AS doc_id FROM placed)
  WHERE next IS NOT NULL)"""
ORACLE["next_token_pairs"] = on_packed(
    PLACED,
    PAIRS,
    """SELECT split, CAST(token AS INT) AS token, CAST(next AS INT) AS next, count(*) AS n
FROM pairs GROUP BY ALL""",
)

# --- step log ---------------------------------------------------------------------------

LOG = """log AS MATERIALIZED (
  SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step,
    ts, value AS loss, event_type AS phase FROM events)"""
TIMED = """timed AS (SELECT *, step_us / 1e6::DOUBLE AS step_s FROM (
    SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY run ORDER BY step)) AS step_us FROM log))"""
ROLLED = f"""rolled AS (
  SELECT *, CAST(sum(step_us) OVER recent AS BIGINT) / nullif(count(step_us) OVER recent, 0) / 1e6::DOUBLE AS mean_step_s
  FROM timed WINDOW recent AS (PARTITION BY run ORDER BY step
    ROWS BETWEEN {S.LAST_STEPS - 1} PRECEDING AND CURRENT ROW))"""
RATE = f"({S.TOKENS_PER_STEP} / nullif(step_s, 0))"


def on_log(*steps: str, recursive: bool = False) -> str:
    return with_(LOG, *steps, recursive=recursive)


ORACLE["log_every"] = on_log(f"SELECT run, step, loss FROM log WHERE step % {S.LOG_EVERY} = 0")
ORACLE["step_throughput"] = on_log(
    TIMED,
    f"SELECT run, step, step_s, round({RATE} + 1e-9::DOUBLE, 6) AS tokens_per_s FROM timed",
)
ORACLE["rolling_step_time"] = on_log(
    TIMED, ROLLED, "SELECT run, step, mean_step_s FROM rolled"
)
ORACLE["cumulative_tokens"] = on_log(
    f"""SELECT run, step, CAST(sum({S.TOKENS_PER_STEP}) OVER (PARTITION BY run ORDER BY step) AS BIGINT) AS tokens_total
FROM log"""
)
SMOOTH = """smooth AS (
  SELECT run, step, loss AS e FROM log WHERE step = 0
  UNION ALL
  SELECT n.run, n.step, CASE WHEN p.e = 0 THEN n.loss ELSE 0.95::DOUBLE * p.e + 0.05::DOUBLE * n.loss END
  FROM smooth p JOIN log n ON n.run = p.run AND n.step = p.step + 1)"""
ORACLE["smooth_loss"] = on_log(
    SMOOTH,
    "SELECT run, step, round(e + 1e-9::DOUBLE, 6) AS loss_smooth FROM smooth",
    recursive=True,
)
ORACLE["progress_eta"] = on_log(
    TIMED,
    ROLLED,
    f"""SELECT run, step, round((step + 1) / {S.STEPS}::DOUBLE * 100 + 1e-9::DOUBLE, 6) AS percent,
  round(mean_step_s * ({S.STEPS} - step - 1) / 3600 + 1e-9::DOUBLE, 6) AS hours_left FROM rolled""",
)
ORACLE["mfu"] = on_log(
    TIMED,
    f"SELECT run, step, round({RATE} * (6 * {S.PARAMETERS}) / 1e12::DOUBLE / 312 + 1e-9::DOUBLE, 6) AS mfu FROM timed",
)
ORACLE["warmup_flag"] = on_log("SELECT run, step, step < 3 AS warming_up FROM log")
ORACLE["phase_share"] = on_log(
    "SELECT run, step - step % 10 AS step, "
    + ", ".join(
        f"round(coalesce(sum(loss) FILTER (phase = '{p}'), 0) / sum(loss) * 100 + 1e-9::DOUBLE, 6) AS {p}_percent"
        for p in S.PHASES
    )
    + " FROM log GROUP BY 1, 2"
)


def cosine(top: str, floor: str) -> str:
    return f"{floor} + 0.5::DOUBLE * (1 + cos(pi() * ((step - 10) / 50::DOUBLE))) * ({top} - {floor})"


ORACLE["lr_schedule"] = on_log(
    f"""SELECT run, step,
  round(CASE WHEN step < 10 THEN 3e-4::DOUBLE * (step + 1) / 10 WHEN step >= 60 THEN 3e-5::DOUBLE
    ELSE {cosine('3e-4::DOUBLE', '3e-5::DOUBLE')} END * 1e6::DOUBLE + 1e-9::DOUBLE, 6) AS pretrain_rate_e6,
  round(CASE WHEN step < 10 THEN 2e-5::DOUBLE * step / 10 WHEN step > 60 THEN 2e-6::DOUBLE
    ELSE {cosine('2e-5::DOUBLE', '2e-6::DOUBLE')} END * 1e6::DOUBLE + 1e-9::DOUBLE, 6) AS tuning_rate_e6 FROM log"""
)
ORACLE["mean_eval_loss"] = on_log(
    "SELECT step, phase AS split, count(*) AS batches, round(avg(loss) + 1e-9::DOUBLE, 6) AS loss FROM log GROUP BY 1, 2"
)
ORACLE["perplexity"] = on_log(
    "SELECT run, step, round(exp(least(loss, 20)) + 1e-9::DOUBLE, 2) AS perplexity FROM log"
)
ORACLE["best_so_far"] = on_log(
    """SELECT run, step, min(loss) OVER upto AS best, coalesce(loss < min(loss) OVER earlier, true) AS improved
FROM log WINDOW upto AS (PARTITION BY run ORDER BY step),
  earlier AS (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
ORACLE["best_checkpoint"] = on_log(
    """SELECT run, step, loss FROM log
QUALIFY row_number() OVER (PARTITION BY run ORDER BY loss, step) = 1"""
)
ORACLE["retain_last"] = on_log(
    f"""SELECT run, step, row_number() OVER newest <= {S.KEEP_LAST} AS kept, row_number() OVER newest = 1 AS latest
FROM log WHERE step > 0 AND step % {S.SAVE_EVERY} = 0 WINDOW newest AS (PARTITION BY run ORDER BY step DESC)"""
)
ORACLE["run_summary"] = on_log(
    f"""totals AS (
  SELECT run, count(*) AS steps, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE AS s,
    arg_max(loss, step) AS final_loss, min(loss) AS best_loss FROM log GROUP BY run),
rated AS (SELECT *, (steps - 1) * {S.TOKENS_PER_STEP} / nullif(s, 0) AS rate FROM totals)""",
    f"""SELECT run, steps, round(s / 3600 + 1e-9::DOUBLE, 6) AS hours, steps * {S.TOKENS_PER_STEP} AS tokens,
  round(rate + 1e-9::DOUBLE, 6) AS tokens_per_s, round(rate * (6 * {S.PARAMETERS}) / 1e12::DOUBLE / 312 + 1e-9::DOUBLE, 6) AS mfu,
  final_loss, round(exp(least(final_loss, 20)) + 1e-9::DOUBLE, 2) AS final_perplexity,
  best_loss, round(exp(least(best_loss, 20)) + 1e-9::DOUBLE, 2) AS best_perplexity FROM rated""",
)
ORACLE["live_step_log"] = on_log(
    TIMED,
    SMOOTH,
    f"""SELECT run, step, step_s, round({RATE} + 1e-9::DOUBLE, 6) AS tokens_per_s, min(loss) OVER upto AS best,
  coalesce(loss < min(loss) OVER earlier, true) AS improved, round(e + 1e-9::DOUBLE, 6) AS loss_smooth
FROM timed JOIN smooth USING (run, step) WINDOW upto AS (PARTITION BY run ORDER BY step),
  earlier AS (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    recursive=True,
)
ORACLE["live_throughput"] = ORACLE["batch_throughput"] = """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS events,
  round(count(*) / 86400::DOUBLE + 1e-9::DOUBLE, 6) AS per_s
FROM events GROUP BY date_trunc('day', ts), event_type
HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""

# --- n-gram jobs ------------------------------------------------------------------------

BIGRAMS = """bigrams AS MATERIALIZED (
  SELECT token, next, count(*) AS n FROM pairs WHERE split = 'train' GROUP BY token, next)"""
LOSSES = f"""losses AS MATERIALIZED (
  SELECT pairs.split, pairs.doc_id,
    -ln((coalesce(n, 0) + 1) / (coalesce(context_n, 0) + {S.VOCAB_SIZE})::DOUBLE) AS loss
  FROM pairs LEFT JOIN bigrams USING (token, next)
    LEFT JOIN (SELECT token, sum(n) AS context_n FROM bigrams GROUP BY token) USING (token))"""
ORACLE["bigram_counts"] = on_packed(PLACED, PAIRS, BIGRAMS, "SELECT token, next, n FROM bigrams")
for name, key in (("bigram_loss", "split"), ("document_perplexity", "doc_id")):
    ORACLE[name] = on_packed(
        PLACED,
        PAIRS,
        BIGRAMS,
        LOSSES,
        f"""SELECT {key}, count(*) AS targets, round(avg(loss) + 1e-9::DOUBLE, 6) AS loss,
  round(exp(least(avg(loss), 20)) + 1e-9::DOUBLE, 6) AS perplexity FROM losses GROUP BY {key}""",
    )
SCORES = "scores AS MATERIALIZED (SELECT token AS context, next, ln(n::DOUBLE) AS score, n FROM bigrams)"
PENALISED = f"""penalised AS MATERIALIZED (
  SELECT ids.doc_id, s.context, s.next,
    CASE WHEN recent.token IS NULL THEN s.score ELSE s.score / {S.PENALTY}::DOUBLE END AS score
  FROM ids JOIN scores s ON s.context = ids.token AND back = 1
    LEFT JOIN recent ON recent.doc_id = ids.doc_id AND recent.token = s.next)"""
TOP = f"""top AS MATERIALIZED (
  SELECT context, next, score FROM scores
  QUALIFY rank() OVER (PARTITION BY context ORDER BY n DESC) <= {S.TOP_K})"""


def soft(name: str, source: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT context, next, score, e / sum(e) OVER (PARTITION BY context) AS p FROM (
    SELECT *, exp(score / {S.TEMPERATURE}::DOUBLE
      - max(score / {S.TEMPERATURE}::DOUBLE) OVER (PARTITION BY context)) AS e FROM {source}))"""


NGRAM_STEPS = (PLACED, PAIRS, BIGRAMS, SCORES)
ORACLE["top_k_next"] = on_packed(
    *NGRAM_STEPS, TOP, "SELECT context, next, round(score + 1e-9::DOUBLE, 6) AS score FROM top"
)
ORACLE["softmax_group"] = on_packed(
    *NGRAM_STEPS,
    soft("weighted", "scores"),
    "SELECT context, next, round(score + 1e-9::DOUBLE, 6) AS score, round(p + 1e-9::DOUBLE, 6) AS p FROM weighted",
)
ORACLE["weighted_draw"] = on_packed(
    *NGRAM_STEPS,
    TOP,
    soft("weighted", "top"),
    f"""SELECT context, coalesce(min(next) FILTER (through >= CAST('0x' || substr({hashed('context')}, 1, 8) AS BIGINT)
    / 4294967296::DOUBLE), max(next)) AS next
FROM (SELECT *, sum(p) OVER (PARTITION BY context ORDER BY next) AS through FROM weighted) GROUP BY context""",
)
RECENT_STEPS = (
    *NGRAM_STEPS,
    f"""ids AS MATERIALIZED (
  SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) - 1 AS back
  FROM doc_tokens JOIN split_docs USING (doc_id)),
recent AS (SELECT DISTINCT doc_id, token FROM ids WHERE back BETWEEN 1 AND {S.RECENT})""",
    PENALISED,
)
ORACLE["repetition_penalty"] = on_packed(
    *RECENT_STEPS,
    f"""SELECT doc_id, context, next, round(score + 1e-9::DOUBLE, 6) AS score FROM penalised
QUALIFY rank() OVER (PARTITION BY doc_id ORDER BY score DESC) <= {S.TOP_K}""",
)
ORACLE["sample_next"] = on_packed(
    *RECENT_STEPS,
    f"""best AS MATERIALIZED (
  SELECT doc_id, next, exp(score / {S.TEMPERATURE}::DOUBLE) AS weight,
    (CAST('0x' || substr({hashed("doc_id || ':' || next")}, 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE AS u
  FROM penalised QUALIFY rank() OVER (PARTITION BY doc_id ORDER BY score DESC) <= {S.TOP_K})""",
    "SELECT doc_id, CAST(arg_min(next, -ln(u) / weight) AS BIGINT) AS next FROM best GROUP BY doc_id",
)
