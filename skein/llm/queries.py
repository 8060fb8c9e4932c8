"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, chat, decontam, exact_dedup, langid, licenses, pii, quality, simhash, warc
from skein.llm.shared import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(table(spark, sf_dir, "pages"))


#: The schema of the tool that the turns call. Fixed values.
REPLY = {"properties": {"text": {"type": "string"}, "chars": {"type": "integer", "minimum": 1, "maximum": 1500}, "tone": {"type": ["string", "null"], "enum": ["calm", "brisk", None]}}, "required": ["chars", "text"], "additionalProperties": False}


def tool_turns(conversations: DataFrame) -> DataFrame:
    """The conversations as calls and results, as the table has none: each of an assistant's turns calls a tool with its
    text, and a user's turn is the result of a call at the turn before. By the text's length some calls need the result
    of the call two turns earlier or later, some lack an argument, have a wrong one or call an unknown tool; turns from
    the sixth on repeat an identifier, and results without a call come where a conversation begins otherwise."""
    size = F.length("text")
    named = lambda n: F.concat(F.lit("call_"), n.cast("string"))
    needs = F.when((F.col("turn") >= 3) & (size % 2 == 0), F.array(named(F.col("turn") - 2))).when((F.col("turn") < 3) & (size % 5 == 0), F.array(named(F.col("turn") + 2)))
    tone = F.when(size % 3 == 0, "calm").when(size % 3 == 1, "brisk").otherwise("loud")
    arguments = F.to_json(F.struct(tone.alias("tone"), F.col("text"), F.when(size % 7 > 0, size).alias("chars"), F.when(size % 13 == 0, size).alias("more")))
    call = F.struct(named(F.least("turn", F.lit(5))).alias("id"), F.when(size % 11 == 0, "lookup").otherwise("reply").alias("name"), arguments.alias("arguments"), needs.alias("depends_on"))
    made = F.to_json(F.struct(F.array(call).alias("tool_calls")))
    got = F.to_json(F.struct(named(F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content")))
    calls, answers = F.col("role") == "assistant", (F.col("role") == "user") & (F.col("turn") > 0)
    return conversations.select("conv_id", "turn", F.when(answers, "tool").otherwise(F.col("role")).alias("role"), F.when(calls, made).when(answers, got).otherwise(F.col("text")).alias("text"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(tool_turns(table(spark, sf_dir, "conversations")), chat.schema_table(spark, {"reply": REPLY}))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_pii": op2_pii,
    "op3_simhash": op3_simhash,
    "op4_language_id": op4_language_id,
    "op5_decontam": op5_decontam,
    "op6_bpe": op6_bpe,
    "op7_warc": op7_warc,
    "op8_chat": op8_chat,
    "op9_quality": op9_quality,
    "op10_licenses": op10_licenses,
}
#: Base32 of a hexadecimal SHA-1 in DuckDB: eight digits of five bits from each 40 bits.
_BASE32 = """array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(sha, 1 + 10 * CAST(k // 8 AS INT), 10) AS BIGINT) >> (35 - 5 * CAST(k % 8 AS INT))) & 31 AS INT), 1)), '')"""



def _license_sql() -> str:
    """The scan in DuckDB: the same patterns and spellings over the documents and the known texts."""

    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    lines = f"regexp_replace(lower(coalesce(text, '')), {text('(?m)' + licenses.COPYRIGHT)}, '', 'g')"
    lines = f"regexp_replace({lines}, {text(licenses.PUNCTUATION)}, ' ', 'g')"
    for own, one in licenses.SPELLINGS:
        lines = f"replace({lines}, {text(own)}, {text(one)})"
    one = "trim(regexp_replace(lines, '[ \\n]+', ' ', 'g'), ' ')"
    for own, other in licenses.DIVISIBLE:
        one = f"replace({one}, {text(own)}, {text(other)})"
    known = lambda rows: f"SELECT sha256({one}) AS digest, min(license_id) AS license_id FROM (SELECT license_id, {lines} AS lines FROM (VALUES {', '.join(f'({text(i)}, {text(t)})' for i, t in rows)}) AS v(license_id, text)) GROUP BY 1"
    pinned = ", ".join(f"('{digest}', '{i}')" for i, digest in licenses.pinned())
    return f"""
        WITH notices AS ({known(licenses.notice_texts())}),
             known AS (SELECT digest, min(license_id) AS license_id FROM ({known([*licenses.license_texts(), *licenses.notice_texts()])} UNION ALL VALUES {pinned}) GROUP BY 1),
             d AS (SELECT doc_id, {lines} AS lines FROM documents),
             l AS (SELECT DISTINCT doc_id, license_id FROM (SELECT doc_id, sha256(trim(unnest(string_split(lines, chr(10))), ' ')) AS digest FROM d) JOIN notices USING (digest)),
             n AS (SELECT doc_id, string_agg(license_id, ',' ORDER BY license_id) AS notice_ids FROM l GROUP BY doc_id)
        SELECT d.doc_id, sha256({one}) AS text_digest, known.license_id, coalesce(notice_ids, '') AS notice_ids
        FROM d LEFT JOIN known ON known.digest = sha256({one}) LEFT JOIN n USING (doc_id)"""


ORACLE_SQL = {
    "op1_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER w = 1 AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)""",
    "op7_warc": f"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
             q AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first_id FROM p)
        SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
        FROM q""",
    "op8_chat": """
        WITH RECURSIVE j AS (SELECT conv_id, turn, role, text, length(text) AS size, coalesce(CAST(to_json(text) AS VARCHAR), 'null') AS own FROM conversations),
        calls AS (SELECT *, 'call_' || least(turn, 5) AS id, CASE WHEN size % 11 = 0 THEN 'lookup' ELSE 'reply' END AS name,
                         CASE WHEN turn >= 3 AND size % 2 = 0 THEN 'call_' || (turn - 2) WHEN turn < 3 AND size % 5 = 0 THEN 'call_' || (turn + 2) END AS needs FROM j WHERE role = 'assistant'),
        firsts AS (SELECT conv_id, id, min(turn) AS call_turn, arg_min(name, turn) AS name FROM calls GROUP BY ALL),
        results AS (SELECT j.conv_id, j.turn, j.own, 'call_' || (j.turn - 1) AS id, call_turn, name FROM j LEFT JOIN firsts ON firsts.conv_id = j.conv_id AND firsts.id = 'call_' || (j.turn - 1) WHERE role = 'user' AND j.turn > 0),
        follows AS (SELECT conv_id, turn, call_turn AS before FROM results UNION ALL
                    SELECT calls.conv_id, calls.turn, results.turn FROM calls LEFT JOIN results ON results.conv_id = calls.conv_id AND results.id = calls.needs),
        placed AS (SELECT conv_id, turn, turn AS t, CAST(0 AS BIGINT) AS level FROM follows WHERE before IS NULL UNION ALL
                   SELECT f.conv_id, f.turn, greatest(f.turn, p.t), CASE WHEN f.turn > p.t THEN 0 ELSE p.level + 1 END FROM follows f JOIN placed p ON p.conv_id = f.conv_id AND p.turn = f.before),
        told AS (
            SELECT calls.conv_id, calls.turn, 'calls' AS kind, CAST(1 AS BIGINT) AS n_calls, CAST(NULL AS BIGINT) AS call_turn,
                   [CASE WHEN firsts.call_turn < calls.turn THEN 'repeated id' END, CASE WHEN calls.name = 'lookup' THEN 'unknown tool lookup' END,
                    CASE WHEN calls.name = 'reply' AND size % 7 = 0 THEN 'reply.chars: missing' WHEN calls.name = 'reply' AND size > 1500 THEN 'reply.chars: too large' WHEN calls.name = 'reply' AND size < 1 THEN 'reply.chars: too small' END,
                    CASE WHEN calls.name = 'reply' AND size % 3 = 2 THEN 'reply.tone: not allowed' END, CASE WHEN calls.name = 'reply' AND size % 13 = 0 THEN 'reply.more: unknown' END] AS problems,
                   '{"content":null,"role":"assistant","tool_calls":[{"arguments":{' || CASE WHEN size % 7 > 0 THEN '"chars":' || size || ',' ELSE '' END || CASE WHEN size % 13 = 0 THEN '"more":' || size || ',' ELSE '' END
                   || '"text":' || own || ',"tone":"' || CASE size % 3 WHEN 0 THEN 'calm' WHEN 1 THEN 'brisk' ELSE 'loud' END || '"},' || coalesce('"depends_on":["' || needs || '"],', '')
                   || '"id":"' || calls.id || '","name":"' || calls.name || '"}]}' AS message
            FROM calls JOIN firsts USING (conv_id, id)
            UNION ALL
            SELECT conv_id, turn, 'result', 0, call_turn, [CASE WHEN call_turn IS NULL THEN 'no call' END],
                   '{"content":' || own || ',"name":' || coalesce('"' || name || '"', 'null') || ',"role":"tool","tool_call_id":"' || id || '"}' FROM results)
        SELECT conv_id, turn, kind, coalesce(t, turn) AS order_turn, coalesce(level, 0) AS order_level, n_calls, call_turn,
               array_to_string(list_sort(list_filter(list_append(problems, CASE WHEN t IS NULL THEN 'circular' END), lambda x: x IS NOT NULL)), '; ') AS problems, message
        FROM told LEFT JOIN placed USING (conv_id, turn)
        UNION ALL
        SELECT conv_id, turn, 'message', turn, 0, 0, NULL, '', '{"content":' || own || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}' FROM j WHERE NOT coalesce(role = 'assistant' OR role = 'user' AND turn > 0, false)""",
    "op10_licenses": _license_sql(),
}
