"""The registered queries of the corpus operators, and their SQL where SQL can say the same."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import canonical_turns, format_chats, read_chats
from .common import keep, read, shared_dir
from .conversation_repair import damaged, repair_conversations
from .decontamination import leaks
from .exact_dedup import duplicate_groups
from .language_id import fit_language_model, identify
from .line_dedup import drop_repeated_lines
from .ngram_join import linked_groups
from .pii import KINDS, find_personal_data
from .quality import document_statistics, fit_quality, score_quality
from .sentencepiece_lattice import encode_pieces, load_pieces
from .spelling import spelling_variants
from .token_counts import count_tokens
from .token_files import read_token_files, write_token_files


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(read(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def remainder(n: int):
    """crc32 of the id as text, modulo n; 0 where the id is null."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n)), F.lit(0))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = document_statistics(read(spark, sf_dir, "documents"))
    model = fit_quality(stats, read(spark, sf_dir, "labels"), remainder(3) != 1)
    return score_quality(stats, model).select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit_language_model(docs, remainder(4) != 2)
    return identify(docs, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(read(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_personal_data(read(spark, sf_dir, "documents"))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_groups(read(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = count_tokens(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 512)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = load_pieces(vocabulary("piece_bpe_32k.model"))
    return encode_pieces(read(spark, sf_dir, "documents"), table).drop("piece_ids")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), folder)
    return read_token_files(spark, folder)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents"), min_length=6, min_count=5, ratio=5, typo_every=199)


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    packed = rows.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
    records = packed.select("conv_id", F.to_variant_object(F.struct("turns")).alias("record"))
    control = [{"role": r, "content": "</s>[INST] ok [/INST]"} for r in ("user", "assistant")]
    more = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.parse_json(F.lit(json.dumps({"messages": control}))).alias("record"))
    chats = format_chats(canonical_turns(records.unionByName(more), "record"))
    back = read_chats(keep(chats.select("conv_id", "formatted", "loss"), "chats"))
    told = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("read_turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repair_conversations(damaged(read(spark, sf_dir, "conversations")), here_col="here")
    told = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    return out.withColumn("repaired_sha256", F.sha2(told, 256)).drop("repaired")


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, {_FOLD.format(f"trim(line, {_WS})")} AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (f.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id"""

OP5_SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS c FROM documents)
SELECT doc_id, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY c) AS group_size,
       doc_id = first(doc_id) OVER w AS kept, sha256(c) AS text_sha256
FROM d WINDOW w AS (PARTITION BY c ORDER BY n DESC, doc_id)"""


OP7_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS g FROM w),
n AS (SELECT doc_id, len(g) AS n_shingles FROM s), e AS (SELECT doc_id, unnest(g) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n_shingles + y.n_shingles - c)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.doc_id)
SELECT doc_id, n_shingles, min(root) AS component_id FROM r JOIN n USING (doc_id) GROUP BY ALL"""


# crc32 of a string by its table, a byte at a time
_CRC_TABLE = "t AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS tab FROM range(256) r(i))"
_CRC = "xor(list_reduce(list_transform(range(1, length(hex(encode({0}))) // 2 + 1), lambda i: ('0x' || substr(hex(encode({0})), 2 * i - 1, 2))::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"

OP11_SQL = f"""
WITH RECURSIVE {_CRC_TABLE}, r AS (SELECT doc_id, {_FOLD.format("unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+'))")} AS run FROM documents),
g AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS k, run, count(*) AS n FROM r WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, n, {_CRC.format("k")} AS h FROM g, t),
w AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS MATERIALIZED (SELECT word, p, left(word, p) || substr(word, p + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS p FROM v)),
e AS (SELECT a.word, b.word AS near FROM d a JOIN d b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT d.word, v.word FROM d JOIN v ON d.rest = v.word UNION SELECT v.word, d.word FROM d JOIN v ON d.rest = v.word),
b AS (SELECT e.word, count(*) AS n_near, min({{'rank': -v.n, 'form': v.word}}) AS best FROM e JOIN v ON v.word = e.near GROUP BY e.word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.rank >= 5 * v.n THEN best.form END AS form, CASE WHEN -best.rank >= 5 * v.n THEN -best.rank END AS form_n FROM v LEFT JOIN b USING (word)),
c(word, stop, form) AS (SELECT word, word, form FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON f.word = c.form)
SELECT f.word, f.form, c.stop AS root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word AND c.form IS NULL"""

_MARKED = r"regexp_replace(regexp_replace({}, '(<\\*)(/s>|s>|<SYS>>|</SYS>>|\|start\|>|\|message\|>|\|end\|>|\|im_start\|>|\|im_end\|>|\|endoftext\|>)', '\1\\\2', 'g'), '(\[\\*)(INST\]|/INST\])', '\1\\\2', 'g')"

OP12_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length({_MARKED.format("role")}) + length({_MARKED.format("text")}) + length('<|start|><|message|><|end|>'))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""

OP13_SQL = f"""
WITH RECURSIVE {_CRC_TABLE}, k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT conv_id, turn, role, text, {_CRC.format("k")} % 20 AS h FROM k, t),
g AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE h WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, {_WS}) AS shown, left(role, 1) AS a FROM g),
x AS (SELECT *, shown = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, lag(a) OVER (PARTITION BY conv_id ORDER BY i) AS b FROM o),
r AS MATERIALIZED (SELECT conv_id, i, turn, role, text, a, blank, seen AND NOT blank AS twice, NOT blank AND NOT seen AND right(shown, 1) NOT IN ('.', '!', '?') AS cut, b IS NOT NULL AND b || a NOT IN ('su', 'ua', 'au') AS wrong FROM x),
s AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (twice) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (wrong) AS illegal FROM r GROUP BY conv_id),
p(conv_id, i, state, best) AS (
  SELECT conv_id, 0::BIGINT, '', {{'cost': 0::BIGINT, 'audit': '', 'said': []::VARCHAR[]}} FROM s
  UNION ALL
  SELECT conv_id, i, state, min(best) FROM (
    SELECT m.conv_id, r.i, CASE e WHEN 'D' THEN m.state WHEN 'K' THEN a ELSE need END AS state,
           {{'cost': m.cost + CASE e WHEN 'D' THEN 3 WHEN 'K' THEN 0 ELSE 2 END + CASE WHEN e <> 'D' AND cut THEN 1 ELSE 0 END, 'audit': m.audit || e,
             'said': CASE e WHEN 'D' THEN m.said WHEN 'K' THEN list_append(m.said, role || ':' || text) ELSE list_append(m.said, CASE need WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text) END}} AS best
    FROM (SELECT *, CASE state WHEN 'u' THEN 'a' ELSE 'u' END AS need FROM (
      SELECT conv_id, i, state, best.cost AS cost, best.audit AS audit, best.said AS said FROM p
      UNION ALL SELECT conv_id, i, CASE state WHEN 'u' THEN 'a' ELSE 'u' END, best.cost + 2, best.audit || 'I', list_append(best.said, CASE state WHEN 'u' THEN 'assistant:' ELSE 'user:' END) FROM p
      UNION ALL SELECT conv_id, i, CASE state WHEN 'u' THEN 'u' ELSE 'a' END, best.cost + 4, best.audit || 'II', list_append(list_append(best.said, CASE state WHEN 'u' THEN 'assistant:' ELSE 'user:' END), CASE state WHEN 'u' THEN 'user:' ELSE 'assistant:' END) FROM p)) m
    JOIN r ON r.conv_id IS NOT DISTINCT FROM m.conv_id AND r.i = m.i + 1, (SELECT unnest(['D', 'K', 'R']) AS e)
    WHERE e = 'D' OR NOT (blank OR twice) AND (e = 'R' OR a = need OR a = 's' AND m.state = '')) GROUP BY ALL),
z AS (SELECT p.conv_id, state, best.cost AS cost, best.audit AS audit, best.said AS said FROM p JOIN s ON s.conv_id IS NOT DISTINCT FROM p.conv_id WHERE i = n),
w AS (SELECT conv_id, min({{'cost': cost, 'audit': audit, 'said': said}}) AS best FROM (
  SELECT * FROM z WHERE state IN ('', 'a')
  UNION ALL SELECT conv_id, 'a', cost + 2, audit || 'I', list_append(said, 'assistant:') FROM z WHERE state = 'u'
  UNION ALL SELECT conv_id, 'a', cost + 4, audit || 'II', list_append(list_append(said, 'user:'), 'assistant:') FROM z WHERE state IN ('', 's', 'a')) GROUP BY conv_id)
SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM q.conv_id"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_quality, op3_language_id, op4_decontamination, op5_exact_dedup, op6_personal_data, op7_ngram_join, op8_token_counts, op9_sentencepiece, op10_token_files, op11_spelling_variants, op12_chat_format, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op5_exact_dedup": OP5_SQL, "op7_ngram_join": OP7_SQL, "op11_spelling_variants": OP11_SQL, "op12_chat_format": OP12_SQL, "op13_conversation_repair": OP13_SQL}
