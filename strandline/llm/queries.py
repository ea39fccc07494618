"""The queries of this subpackage: opN_<name>(spark, sf_dir) and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import table


def op1_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of every document that match a licence template, with the best template."""
    from strandline.llm import license_scan

    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of good quality of every document, from two co-trained views."""
    from strandline.llm import quality

    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op3_rans_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written in the binary format and read back."""
    import public_tokenizers

    from strandline.llm import ans

    found = ans.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return found.select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


def op4_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document contains, with the best window."""
    from strandline.llm import decontam

    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    from strandline.llm import langid

    docs = table(spark, sf_dir, "documents")
    model = langid.fit(langid.sample(docs.filter(~langid.held_out())))
    # doc_id is carried along; the prediction sees the text only.
    found = langid.identify(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document and what they decode to, as digests."""
    import public_tokenizers

    from strandline.llm import bpe

    vocabulary, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary, pattern)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: The rules of the URL query: host, path prefix, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    from strandline.llm import url_filter

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op8_chat_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that imitates control strings, formatted and read back."""
    from strandline.llm import chat

    odd = [(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(odd, rows.schema))
    turns, learned = chat.read_turns(F.col("formatted")), chat.loss_text(F.col("segments"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = chat.format_conversations(rows).select("conv_id", "formatted", turns.alias("turns"), learned.alias("learned"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a PNG picture, read back, with a cosine hash."""
    from strandline.llm import media

    found = media.read(media.store(table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op10_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    from strandline.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_pca_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector, with the clusters' inertia and centroids."""
    from strandline.llm import centroids

    return centroids.cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


def op12_viterbi_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every conversation after damage, and its cheapest repair."""
    from strandline.llm import repair

    rows = table(spark, sf_dir, "conversations")
    return repair.report(repair.damaged(rows), rows)


def op13_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of rows that are not held out."""
    from strandline.llm import langid, toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(toxicity.sample(docs, labels.filter(~langid.held_out())))
    # doc_id is carried along; the score sees the text only.
    return toxicity.score(docs, model).select("doc_id", langid.held_out().alias("held_out"), "score", "predicted")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_dice": op1_license_dice,
    "op2_cotraining_quality": op2_cotraining_quality,
    "op3_rans_files": op3_rans_files,
    "op4_benchmark_windows": op4_benchmark_windows,
    "op5_cross_parsing_language": op5_cross_parsing_language,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_url_rules": op7_url_rules,
    "op8_chat_blocks": op8_chat_blocks,
    "op9_png_media": op9_png_media,
    "op10_simhash_pivots": op10_simhash_pivots,
    "op11_pca_centroids": op11_pca_centroids,
    "op12_viterbi_repair": op12_viterbi_repair,
    "op13_lexicon_toxicity": op13_lexicon_toxicity,
    "pipeline": pipeline,
}

#: From the definition: every rule tried on every host and path.
URL_SQL = """
WITH rules(host, path, verdict) AS (VALUES %s),
p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
m AS (SELECT h.host, h.path, max({'n': length(r.host || r.path), 'rule': r.host || r.path, 'verdict': r.verdict}) AS best
      FROM (SELECT DISTINCT host, path FROM h) h JOIN rules r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path) GROUP BY ALL)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM h LEFT JOIN m USING (host, path)
""" % ", ".join(map(str, URL_RULES))

#: What the texts say of turns and loss; the template's marks are <s>[ ] </s> for a run of one role and [+] in it.
CHAT_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
e AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\\\<\\[\\]]', '', 'g')) AS n, length(role) + length(regexp_replace(role, '[^\\\\<\\[\\]]', '', 'g')) AS rn FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(n + CASE WHEN before = role THEN 3 ELSE 9 + rn END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def _centroid_sql(rounds: int = 10) -> str:
    """From the definition: every vector measured against every centroid, a pair of tables for each round."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT r, min({{'d': list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'cluster': cluster}}) AS best
    FROM kept CROSS JOIN c{k} GROUP BY r)""")
        if k < rounds:
            steps.append(f"""m{k} AS (SELECT cluster, list(mean ORDER BY j) AS c FROM (SELECT cluster, j, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS mean
    FROM (SELECT best.cluster AS cluster, j, sum(v[j]) AS s, count(*) AS n FROM kept JOIN a{k} USING (r), range(1, 65) AS t(j) GROUP BY ALL)) GROUP BY cluster),
c{k + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (cluster))""")
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS cluster, v AS c FROM kept ORDER BY cluster LIMIT 8),
{",\n".join(steps)},
o AS (SELECT vec_id, best.cluster AS cluster, CAST(best.d AS BIGINT) AS distance FROM kept JOIN a{rounds} USING (r))
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
    CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM o JOIN c{rounds} USING (cluster)
"""

def _repair_sql() -> str:
    """From the definition: cheapest costs and letters of each state (empty, s, u, a) carried forwards, row by row."""

    def paid(state: str, cost: str, letters: str) -> str:
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letters}'}}"

    def inserted(s: str) -> str:
        to_user = ", ".join(paid(f"{s}[{q}]", "5", "I") for q in (1, 2, 4))
        to_assistant = ", ".join([paid(f"{s}[3]", "5", "I"), paid(f"{s}[1]", "10", "II"), paid(f"{s}[2]", "10", "II")])
        return f"[{s}[1], {s}[2], list_min([{s}[3], {to_user}]), list_min([{s}[4], {to_assistant}])]"

    def edited(to: int, keep: str, sources: tuple[int, ...], rerole: bool) -> str:
        keeps = [paid(f"t[{q}]", f"CASE WHEN x.fault < 2 AND x.i = '{keep}' THEN 5 * x.fault ELSE 1000000000 END", "K") for q in sources]
        reroles = [paid(f"t[{q}]", "CASE WHEN x.fault < 2 THEN 5 * x.fault + 1 ELSE 1000000000 END", "R") for q in sources if rerole]
        return f"list_min([{', '.join([paid(f't[{to}]', '2', 'D'), *keeps, *reroles])}])"

    row = f"[{paid('t[1]', '2', 'D')}, {edited(2, 's', (1,), False)}, {edited(3, 'u', (1, 2, 4), True)}, {edited(4, 'a', (3,), True)}]"
    start = "[{'c': 0::BIGINT, 'a': ''}, {'c': 1000000000::BIGINT, 'a': ''}, {'c': 1000000000::BIGINT, 'a': ''}, {'c': 1000000000::BIGINT, 'a': ''}]"
    return f"""
WITH tab AS (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) ORDER BY b) AS crc FROM range(256) AS t(b)),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
f AS (SELECT k.*, xor(list_reduce(list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: xor(a // 256, crc[1 + xor(a % 256, b)]), 4294967295), 4294967295) % 20 AS fault FROM k, tab),
d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
        CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM f, range(2) AS c(copy) WHERE fault <> 0 AND (copy = 0 OR fault = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), sha256(text)) AS n, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d),
r AS (SELECT *, CASE WHEN bare = '' THEN 2 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 3 WHEN right(bare, 1) IN ('.', '!', '?') THEN 0 ELSE 1 END AS fault,
        left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair FROM o),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 2) AS blank, count(*) FILTER (fault = 3) AS duplicate,
        count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, list({{'i': i, 'fault': fault, 'role': role, 'text': text}} ORDER BY n) AS own FROM r GROUP BY conv_id),
v AS (SELECT *, list_reduce(own, lambda s, x: list_transform([{inserted('s')}], lambda t: {row})[1], {start}) AS s FROM g),
w AS (SELECT *, list_min([e[1], e[4]]) AS best FROM (SELECT *, {inserted('s')} AS e FROM v)),
m AS (SELECT *, list_reduce(string_split(best.a, ''), lambda z, e: CASE e
        WHEN 'D' THEN {{'k': z.k + 1, 'last': z.last, 'told': z.told}}
        WHEN 'K' THEN {{'k': z.k + 1, 'last': left(own[z.k + 1].role, 1), 'told': list_append(z.told, own[z.k + 1].role || ':' || own[z.k + 1].text)}}
        WHEN 'R' THEN {{'k': z.k + 1, 'last': CASE WHEN z.last = 'u' THEN 'a' ELSE 'u' END, 'told': list_append(z.told, CASE WHEN z.last = 'u' THEN 'assistant:' ELSE 'user:' END || own[z.k + 1].text)}}
        WHEN 'I' THEN {{'k': z.k, 'last': CASE WHEN z.last = 'u' THEN 'a' ELSE 'u' END, 'told': list_append(z.told, CASE WHEN z.last = 'u' THEN 'assistant:' ELSE 'user:' END)}}
        ELSE z END, {{'k': 0::BIGINT, 'last': '', 'told': []::VARCHAR[]}}) AS mended FROM w)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
    coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(mended.told, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN m ON c.conv_id IS NOT DISTINCT FROM m.conv_id
"""


def _license_sql() -> str:
    from strandline.llm import license_scan

    return license_scan.scan_sql()


ORACLE_SQL: dict[str, str] = {"op1_license_dice": _license_sql(), "op7_url_rules": URL_SQL, "op8_chat_blocks": CHAT_SQL, "op11_pca_centroids": _centroid_sql(), "op12_viterbi_repair": _repair_sql()}
