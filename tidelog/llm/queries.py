"""The queries of this subpackage, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import chat, licenses, mixing, near_dedup, pieces, quality, secrets, suffix_dedup, token_files
from tidelog.llm.common import LOWER, UPPER, table
from tidelog.llm.exact_dedup import exact_dedup


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op3_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"))


def op5_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == secrets.KINDS.index(kind))).cast("long")
    base = F.filter("spans", lambda x: x["kind"] < 3)
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"), count("entropy").alias("n_entropy"))


def op6_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digests(chat.format_chat(turns.unionByName(own)))


def op8_merge_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op9_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"), threshold=50)


def op10_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f for f in (
        op1_license_rules, op2_temperature_mixing, op3_repair_token_files, op4_robust_quality, op5_entropy_secrets, op6_streaming_viterbi,
        op7_chat_windows, op8_merge_index_dedup, op9_prefix_doubling, op10_signature_join, pipeline)
}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _licenses_sql() -> str:
    known = "MAP {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in licenses.SENTENCES.items()) + "}"
    norm = lambda x: f"regexp_replace(trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), {_q(licenses.HOLDER)}, {_q(licenses.HOLDER_KNOWN)})"
    of = lambda x: f"{known}[{norm(x)}]"
    first, second = r"regexp_replace(s, '^[^\n]*\n', '')", r"regexp_replace(s, '^[^\n]*\n[^\n]*\n', '')"
    sentence = f"coalesce({of('s')}, {of(first)}, {of(second)})"
    clauses = f"list_filter(list_transform(string_split_regex(s, {_q(licenses.CLAUSE)}), lambda c: {of('c')}), lambda x: x IS NOT NULL)"
    hint = "|".join(licenses.hint_words(licenses.SENTENCES))
    steps = "SELECT *, ' ' || array_to_string(sentence_ids, ' ') || ' ' AS seq, CAST([] AS VARCHAR[]) AS lic0, CAST([] AS VARCHAR[]) AS used0 FROM ids"
    for i, (name, parts) in enumerate(licenses.RULES, 1):
        pattern = " " + "(?:.* )?".join(p.replace(".", r"\.") + " " for p in parts)
        own = "[" + ", ".join(map(_q, parts)) + "]"
        steps = (
            f"SELECT * EXCLUDE (lic{i - 1}, used{i - 1}, hit{i}), CASE WHEN hit{i} AND NOT list_contains(lic{i - 1}, {_q(name)}) THEN list_append(lic{i - 1}, {_q(name)}) ELSE lic{i - 1} END AS lic{i}, "
            f"CASE WHEN hit{i} THEN list_concat(used{i - 1}, {own}) ELSE used{i - 1} END AS used{i} "
            f"FROM (SELECT *, regexp_matches(seq, {_q(pattern)}) AND NOT list_has_all(used{i - 1}, {own}) AS hit{i} FROM ({steps}))")
    return rf"""
    WITH ids AS (SELECT doc_id, CASE WHEN regexp_matches(lower(coalesce(text, '')), '{hint}') THEN
        flatten(list_transform(string_split_regex(regexp_replace(text, {_q(licenses.VERSION)}, '\1 \2', 'g'), {_q(licenses.BREAK)}),
            lambda s: CASE WHEN {sentence} IS NOT NULL THEN [{sentence}] ELSE {clauses} END)) ELSE CAST([] AS VARCHAR[]) END AS sentence_ids FROM documents)
    SELECT doc_id, sentence_ids, lic{len(licenses.RULES)} AS licenses FROM ({steps})"""


def _secrets_sql() -> str:
    def spans(name: str, pattern: str, group: int, keep: str) -> str:
        p = _q(pattern)
        return f"""list_filter(list_transform(range(0, len(regexp_extract_all(t, {p}))), lambda i: {{'start':
            CAST(coalesce(list_sum(list_transform(string_split_regex(t, {p})[1:i + 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(regexp_extract_all(t, {p})[1:i], lambda x: length(x))), 0) AS BIGINT),
            'kind': {secrets.KINDS.index(name)}, 'text': regexp_extract_all(t, {p})[i + 1], 'part': regexp_extract_all(t, {p}, {group})[i + 1]}}), lambda x: {keep})"""

    n, w = secrets.THRESHOLDS, secrets.WINDOW
    allowed = " OR ".join(f"regexp_matches(x.text, {_q(a)})" for a in secrets.ALLOWED)
    entropy = (
        f"regexp_matches(x.text, '[0-9]') AND regexp_matches(x.text, '[A-Za-z]') AND NOT ({allowed}) AND "
        f"list_max(list_transform(range(0, length(x.text) - {w - 1}), lambda k: list_aggregate(string_split(substring(x.text, k + 1, {w}), ''), 'entropy'))) >= "
        f"CASE WHEN regexp_full_match(x.text, '[0-9a-fA-F]+') THEN {n['hex']} ELSE {n['mixed']} END")
    joined = lambda c: f"array_to_string(list_transform(list_sort({c}), lambda x: {list(secrets.KINDS)}[x.kind + 1] || ':' || x.start || ':' || x.fin), ',')"
    return f"""
    WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    b AS (SELECT doc_id, list_concat({spans('assign', secrets.ASSIGN, 1, 'length(x.part) >= 6')}, {spans('access', secrets.ACCESS, 0, 'true')}, {spans('hex', secrets.HEX, 0, 'true')}) AS base,
        {spans('entropy', secrets.CANDIDATE, 0, entropy)} AS more FROM a),
    c AS (SELECT doc_id, list_transform(base, lambda x: {{'start': x.start, 'kind': x.kind, 'fin': x.start + length(x.text)}}) AS base,
        list_transform(more, lambda x: {{'start': x.start, 'kind': x.kind, 'fin': x.start + length(x.text)}}) AS more FROM b),
    d AS (SELECT doc_id, base, list_filter(more, lambda m: len(list_filter(base, lambda r: r.start <= m.start AND m.fin <= r.fin)) = 0) AS more FROM c)
    SELECT doc_id, CAST(len(list_filter(base, lambda x: x.kind = 0)) AS BIGINT) AS n_assign, CAST(len(list_filter(base, lambda x: x.kind = 1)) AS BIGINT) AS n_access,
        CAST(len(list_filter(base, lambda x: x.kind = 2)) AS BIGINT) AS n_hex, sha256({joined('base')}) AS base_sha256, {joined('list_concat(base, more)')} AS spans,
        CAST(len(more) AS BIGINT) AS n_entropy FROM d"""


def _mixing_sql() -> str:
    m = mixing
    weights = lambda alpha: f"list_transform(p, lambda x: pow(x, {alpha}) / list_sum(list_transform(p, lambda y: pow(y, {alpha}))))"
    ratio = lambda alpha: f"list_transform(range(1, len(p) + 1), lambda i: ({weights(alpha)})[i] / p[i])"
    flat = (
        f"list_max({ratio('(lo + hi) / 2')}) / list_min({ratio('(lo + hi) / 2')}) > {m.MAX_REPEAT} OR "
        f"-list_sum(list_transform({weights('(lo + hi) / 2')}, lambda w: w * ln(w))) > {m.TARGET_ENTROPY} * ln(len(p))")
    key = lambda epoch: f"md5('{m.SEED}:' || source || ':' || {epoch} || ':' || block)"
    return f"""
    WITH RECURSIVE rows_ AS (SELECT doc_id, coalesce(source, '<null>') AS source,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
    totals AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM rows_ GROUP BY 1),
    shares AS (SELECT list(tokens / total ORDER BY source) AS p FROM totals, (SELECT sum(tokens) AS total FROM totals) WHERE tokens > 0),
    bisect AS (SELECT 0 AS k, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
        UNION ALL SELECT k + 1, CASE WHEN {flat} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {flat} THEN hi ELSE (lo + hi) / 2 END FROM bisect, shares WHERE k < {m.STEPS}),
    solved AS (SELECT round(hi, 9) AS alpha FROM bisect WHERE k = {m.STEPS}),
    ratios AS (SELECT source, tokens, pow(tokens / total, alpha) / (tokens / total) AS r FROM totals, (SELECT sum(tokens) AS total FROM totals), solved WHERE tokens > 0),
    plan AS (SELECT t.source, t.tokens, coalesce(round(r / (SELECT min(r) FROM ratios), 6), 1) AS repeats, greatest(1, CAST(ceil(t.tokens / {m.BLOCK_TOKENS}) AS BIGINT)) AS n_blocks
        FROM totals t LEFT JOIN ratios USING (source)),
    dealt AS (SELECT r.*, CAST(floor(repeats) AS INTEGER) AS whole, CAST(floor((repeats - floor(repeats)) * tokens) AS BIGINT) AS rest,
        CAST(('0x' || substring(md5('{m.SEED}' || coalesce(':' || doc_id, '')), 1, 8)) AS BIGINT) % n_blocks AS block FROM rows_ r JOIN plan USING (source)),
    blocks AS (SELECT source, block, whole, rest, sum(n_tokens) AS tokens FROM dealt GROUP BY ALL),
    fits AS (SELECT source, block FROM (SELECT source, block, rest, sum(tokens) OVER (PARTITION BY source ORDER BY {key('(whole + 1)')}) AS upto FROM blocks) WHERE upto <= rest)
    SELECT doc_id, source, n_tokens, CAST(epoch AS INTEGER) AS epoch, block, {key('epoch')} AS block_key
    FROM (SELECT d.*, unnest(range(1, whole + 1 + CASE WHEN f.block IS NULL THEN 0 ELSE 1 END)) AS epoch FROM dealt d LEFT JOIN fits f USING (source, block))"""


def _chat_sql() -> str:
    c = chat
    grown = lambda x: f"length({x}) + " + " + ".join(f"(length({x}) - length(replace({x}, {_q(e)}, '')))" for e, _ in c.ESCAPES)
    order = "PARTITION BY conv_id ORDER BY turn, role, text"
    return f"""
    WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    b AS (SELECT *, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) + 1 AS tokens FROM a),
    c AS (SELECT *, row_number() OVER ({order}) AS n, sum(tokens) OVER ({order} ROWS UNBOUNDED PRECEDING) AS upto,
        CASE WHEN first_value(role) OVER ({order}) = 'system' THEN first_value(tokens) OVER ({order}) ELSE 0 END AS sys FROM b),
    d AS (SELECT *, n = 1 AND sys > 0 AS is_system, greatest(1, floor(({c.BUDGET - c.HISTORY_TOKENS} - sys) / 2)) AS room FROM c),
    e AS (SELECT *, CASE WHEN is_system THEN 0 ELSE floor((upto - sys - 1) / room) END AS slot, NOT is_system AND tokens > room AS big FROM d),
    f AS (SELECT *, CASE WHEN n = 2 AND sys > 0 THEN sys + tokens > {c.BUDGET} ELSE coalesce(slot <> lag(slot) OVER w OR big OR lag(big) OVER w, false) END AS cut FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY n)),
    g AS (SELECT *, sum(CAST(cut AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS win FROM f),
    own AS (SELECT conv_id, win, sum(tokens) AS own FROM g GROUP BY ALL),
    later AS (SELECT o.conv_id, o.win, o.own, s.sys <= {c.BUDGET} - o.own AS fits, count_if(s.sys <= {c.BUDGET} - o.own AND o.win > 0) OVER (PARTITION BY o.conv_id) AS n_fit,
        {c.BUDGET} - o.own - CASE WHEN s.sys <= {c.BUDGET} - o.own THEN s.sys ELSE 0 END AS left_over FROM own o JOIN (SELECT conv_id, max(sys) AS sys FROM g GROUP BY 1) s ON o.conv_id IS NOT DISTINCT FROM s.conv_id),
    i AS (SELECT g.*, row_number() OVER (PARTITION BY g.conv_id, g.win ORDER BY n DESC) AS back, sum(tokens) OVER (PARTITION BY g.conv_id, g.win ORDER BY n DESC ROWS UNBOUNDED PRECEDING) AS tail,
        t.n_fit, x.left_over FROM g JOIN later t ON g.conv_id IS NOT DISTINCT FROM t.conv_id AND g.win = t.win LEFT JOIN later x ON g.conv_id IS NOT DISTINCT FROM x.conv_id AND g.win + 1 = x.win),
    h AS (SELECT *, {grown('role')} + {grown('text')} + {4 + len(c.END)} AS chars, 1 + CASE WHEN is_system THEN n_fit
        WHEN back <= {c.HISTORY_TURNS} AND tail <= {c.HISTORY_TOKENS} AND left_over IS NOT NULL AND tail <= left_over THEN 1 ELSE 0 END AS times FROM i)
    SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars * times) AS BIGINT) AS formatted_chars
    FROM h GROUP BY conv_id"""


ORACLES = {
    "op1_license_rules": _licenses_sql(),
    "op2_temperature_mixing": _mixing_sql(),
    "op5_entropy_secrets": _secrets_sql(),
    "op7_chat_windows": _chat_sql(),
    "op8_merge_index_dedup": f"""
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(k) AS text_sha256
        FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS k FROM documents) WINDOW g AS (PARTITION BY k)""",
}
