"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ._common import table, tokenizer_file
from .chat import CONTROL, END, TEXT, TURN, format_conversations
from .decontaminate import find_contamination
from .exact_dedup import exact_dedup
from .language import identify_languages
from .near_dedup import jaccard_join
from .quality import score_quality
from .sentencepiece_backend import encode_texts
from .sharding import ROUNDS, shard
from .substring_dedup import substring_dedup
from .warc import warc_round_trip

Query = Callable[[SparkSession, str], DataFrame]


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).drop("text_key", "class_key")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


#: A conversation whose texts hold another template's marks.
HOSTILE = "</s>[INST] ok [/INST]"


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", HOSTILE), (-1, 1, "assistant", HOSTILE)], "conv_id long, turn long, role string, text string")
    return format_conversations(rows.unionByName(extra), tokenizer_file("byte_bpe_50k.json")).drop("n_tokens", "n_loss_tokens")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def queries() -> dict[str, Query]:
    return {
        "op1_jaccard_join": op1_jaccard_join,
        "op2_quality": op2_quality,
        "op3_language_id": op3_language_id,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_warc": op5_warc,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_chat_formatting": op7_chat_formatting,
        "op8_decontamination": op8_decontamination,
        "op9_sharding": op9_sharding,
        "op10_sentencepiece": op10_sentencepiece,
    }


def _base32(hexed: str) -> str:
    """DuckDB SQL for the base32 of 40 hex digits: each five digits give four letters."""
    letter = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr({h}, {at}, 5))::BIGINT >> {shift}) & 31)::INT, 1)"
    return " || ".join(letter.format(h=hexed, at=1 + 5 * i, shift=s) for i in range(8) for s in (15, 10, 5, 0))


def _escaped_length(column: str) -> str:
    """DuckDB SQL for the length of an escaped text."""
    marks = [f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in ("\\", *CONTROL)]
    return " + ".join([f"length({column})", *marks])


def _feistel(rows: str) -> str:
    """DuckDB SQL for one application of the network to rows (number, k, n, a, b, p)."""
    made = f"SELECT number, k, n, a, b, p // b AS l, p % b AS r FROM {rows}"
    for step in range(ROUNDS):
        mixed = "(('0x' || substr(md5('17:{step}:' || {half}), 1, 15))::BIGINT % {modulus})"
        if step % 2 == 0:
            made = f"SELECT number, k, n, a, b, (l + {mixed.format(step=step, half='r', modulus='a')}) % a AS l, r FROM ({made})"
        else:
            made = f"SELECT number, k, n, a, b, l, (r + {mixed.format(step=step, half='l', modulus='b')}) % b AS r FROM ({made})"
    return made


#: Words of digits, letters and non-ASCII characters, A-Z lowered.
_ALNUM = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_jaccard_join": r"""
            WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
                 g AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(1, len(ws) - 4) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) AS grams FROM d WHERE len(ws) > 0),
                 s AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM g),
                 met AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c FROM s x JOIN s y USING (gram) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
                 link AS (SELECT * FROM met WHERE c >= 0.8 * (na + nb - c) - 1e-9),
                 reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.other = link.a),
                 class AS (SELECT doc_id, min(other) AS class_id FROM reach GROUP BY 1),
                 degree AS (SELECT a AS doc_id, count(*) AS n_links, count(*) FILTER (c = na AND c = nb) AS same FROM link GROUP BY 1)
            SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, 1 + coalesce(same, 0) AS copies FROM class LEFT JOIN degree USING (doc_id)""",
        "op4_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
                   doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
        "op5_warc": f"""
            WITH p AS (SELECT page_id, coalesce(html, '') AS body, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
                 h AS (SELECT *, sha1(body) AS hexed FROM p)
            SELECT page_id, strlen(body) AS payload_bytes, {_base32("hexed")} AS payload_digest,
                   CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN page_id <> first THEN first END AS refers_to
            FROM h""",
        "op6_substring_dedup": r"""
            WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
                 starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20),
                 win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS w FROM starts),
                 rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS nth FROM win) WHERE nth > 1),
                 cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM rep),
                 word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS j FROM d),
                 kept AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY j) AS body FROM word ANTI JOIN cov USING (doc_id, j) GROUP BY doc_id)
            SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
            FROM d LEFT JOIN kept USING (doc_id)""",
        "op7_chat_formatting": f"""
            WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                       UNION ALL VALUES (-1, 0, 'user', '{HOSTILE}'), (-1, 1, 'assistant', '{HOSTILE}'))
            SELECT conv_id, count(*) AS n_turns,
                   sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                   coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
                   sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
                   sum({len(TURN + TEXT + END) + 1} + {_escaped_length("role")} + {_escaped_length("text")})::BIGINT AS formatted_chars
            FROM c GROUP BY conv_id""",
        "op8_decontamination": f"""
            WITH d AS (SELECT doc_id, {_ALNUM} AS ws FROM documents),
                 b AS (SELECT item_id, ws, least(13, len(ws)) AS n FROM (SELECT item_id, {_ALNUM} AS ws FROM benchmark) WHERE len(ws) > 0),
                 bi AS (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM b),
                 bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM bi),
                 di AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n),
                 hit AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM di) JOIN bw USING (n, win)),
                 words AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS w FROM hit) GROUP BY doc_id),
                 items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS listed FROM hit GROUP BY doc_id)
            SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
                   sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
            FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
        "op9_sharding": f"""
            WITH RECURSIVE size AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT n, greatest(1, ceil(sqrt(n)))::BIGINT AS a FROM (SELECT count(*) AS n FROM documents))),
                 crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
                 d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
                        xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
                            lambda c, y: xor(c >> 8, t[1 + (xor(c, y) & 255)])), 4294967295) AS text_crc32 FROM documents, crc),
                 base AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS number FROM d),
                 walk AS (SELECT number, number AS p, 0 AS k, n, a, b FROM base, size
                          UNION ALL SELECT number, l * b + r, k + 1, n, a, b FROM ({_feistel("walk WHERE k = 0 OR p >= n")})),
                 placed AS (SELECT number, p FROM walk WHERE k > 0 AND p < n)
            SELECT doc_id, size, text_crc32, 'rows' AS law, (p % 8)::INT AS shard, p // 8 AS slot, NULL::INT AS grown_shard, number AS row_number
            FROM base JOIN placed USING (number)""",
    }
