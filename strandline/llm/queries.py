"""The queries ``opN_<name>`` over the whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, brown, langid, merkle, mixing, multiprobe, near_dedup, pieces, pii, sharding, threshold_topk, toxicity, whitening
from .shelf import table


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_held_out(table(spark, sf_dir, "documents"))


def op2_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_topk.top_products(table(spark, sf_dir, "embeddings"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_multiprobe_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiprobe.neighbours(table(spark, sf_dir, "embeddings"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    how = {"path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    done = bpe.encode(table(spark, sf_dir, "documents"), decoded="decoded", keep=["doc_id"], **how)
    return done.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = toxicity.remainder(F.col("doc_id"), 3) == 1
    return langid.predict(docs, langid.fit(docs), score="score", keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = toxicity.remainder(F.col("doc_id"), 3) == 1
    return toxicity.score(docs, model, out="score", keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_spans(docs)
    s = F.col("pii_spans")
    count = lambda kind: F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in pii.BASE),
        F.sha2(pii.joined(F.filter(s, lambda x: x["no"] < len(pii.BASE))), 256).alias("base_sha256"),
        pii.joined(s).alias("spans"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = pieces.encode(table(spark, sf_dir, "documents"), path=public_tokenizers.path("piece_bpe_32k.model"), decoded="decoded", keep=["doc_id"])
    return done.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("piece_ids", ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    made = merkle.manifest(docs, changed={"n_chars": docs["n_chars"] + told.cast("int")})
    return made.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


QUERIES = {
    f.__name__: f
    for f in (
        op1_brown_lm, op2_threshold_topk, op3_mix_sources, op4_near_duplicates, op5_multiprobe_ann,
        op6_byte_bpe, op7_language_id, op8_toxicity, op9_shard, op10_pii, op11_whitening, op12_sentencepiece, op13_merkle_manifest,
    )
}

_OP2 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, 65), lambda i: a.e[i] * b.e[i]))::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
_OP3 = f"""
WITH d AS (SELECT doc_id, source, {_WORDS}::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
             (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
w AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
             coalesce(sum(cap) OVER o, 0) AS caps_before, coalesce(sum(weight) OVER o, 0) AS weights_before
      FROM s WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * (weights - weights_before) <= weight * (total - caps_before) AS capped FROM w),
f AS (SELECT *, total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0) AS rest,
             weights - coalesce(sum(CASE WHEN capped THEN weight END) OVER (), 0) AS open_weights FROM c),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE (weight * rest)::DOUBLE / open_weights::DOUBLE END AS target FROM f),
m AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0 END AS rate,
             ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM m)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM n
"""

#: Links by counting shared shingles of all documents; components by reachability.
_OP4 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
n AS (SELECT doc_id, len(g) AS n FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, b.y FROM reach JOIN both_ways b ON reach.y = b.x)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, r.c AS component_id, n.doc_id = r.c AS kept
FROM n JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON n.doc_id = r.x
"""


def _op10() -> str:
    """Spans from matches and the gaps between them; base kinds by the plain patterns of the contract."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
        "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
        "secret": r"\b[0-9a-f]{32,64}\b",
    }
    digits, bare = "regexp_replace(m, '[^0-9]', '', 'g')", "replace(m, ' ', '')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse({digits})[i]::INT WHEN reverse({digits})[i]::INT > 4 THEN reverse({digits})[i]::INT * 2 - 9 ELSE reverse({digits})[i]::INT * 2 END)) % 10 = 0"
    turned = f"string_split(substr({bare}, 5) || substr({bare}, 1, 4), '')"
    checks = {
        "email": "true",
        "ip": r"len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR ('0' || right(x, 3))::INT > 255)) = 0",
        "card": f"length({digits}) BETWEEN 14 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 10 AND 15",
        "iban": f"length({bare}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform({turned}, lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, x: CASE WHEN x < 10 THEN (a * 10 + x) % 97 ELSE (a * 100 + x) % 97 END) = 1",
        "ssn": "NOT (left(m, 3) IN ('000', '666') OR left(m, 1) = '9' OR substr(m, 5, 2) = '00' OR right(m, 4) = '0000')",
        "secret": "true",
    }
    parts = []
    for no, (kind, pattern) in enumerate(plain.items()):
        near = lambda words: f"(regexp_matches(b, '{words}') OR regexp_matches(a, '{words}'))"  # noqa: E731, B023
        score = f"{pii.PATTERNS[kind][1]} + CASE WHEN {near(pii.RAISE[kind])} THEN {pii.STEP} ELSE 0 END - CASE WHEN {near(pii.LOWER)} THEN {pii.STEP} ELSE 0 END"
        body = "coalesce(text, '')" if kind in pii.BASE else "translate(coalesce(text, ''), '_', ' ')"  # so that \\b takes an underscore for no letter
        keep = "true" if kind in pii.BASE else f"round({score}, 2) >= {pii.THRESHOLD}"
        parts.append(f"""
SELECT doc_id, {no} AS no, '{kind}' AS kind, s, s + length(m) AS e FROM (
  SELECT doc_id, ms[i] AS m, translate(right(gs[i], {pii.REACH}), '_', ' ') AS b, translate(left(coalesce(gs[i + 1], ''), {pii.REACH}), '_', ' ') AS a, list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT doc_id, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all({body}, '{pattern}') AS ms, regexp_split_to_array({body}, '{pattern}') AS gs FROM documents)))
WHERE {checks[kind]} AND {keep}""")
    return f"""
WITH x AS ({" UNION ALL ".join(parts)}),
j AS (SELECT doc_id, {", ".join(f"sum((no = {i})::INT)::BIGINT AS n_{k}" for i, k in enumerate(pii.BASE))},
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) AS spans, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) FILTER (no < 4) AS base FROM x GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN j ON d.doc_id = j.doc_id
"""

#: CRC-32 of the decimal id, bit by bit; trees by a recursion over levels, each node with the number of nodes of its level.
_OP13 = """
WITH RECURSIVE k AS (SELECT row_number() OVER () AS rid, *, list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: CASE WHEN r %% 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)) AS crc FROM documents),
m AS (SELECT *, coalesce(xor(crc, 4294967295) %% 7 = 0, false)::INT AS told FROM k),
f AS (SELECT rid, doc_id, lang, %(head)s || %(n)s || %(text)s AS own, %(head)s || %(told)s || %(text)s AS other FROM m),
h AS (SELECT rid, doc_id, lang, sha256(own) AS leaf, sha256(other) AS other FROM f),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM h),
t AS (SELECT lang, 0 AS lv, pos, n, leaf AS h FROM l
      UNION ALL SELECT lang, min(lv) + 1, pos // 2, (min(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lang, pos // 2),
s AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, lv AS depth FROM t WHERE n = 1),
u AS (SELECT 0 AS lv, pos, n, h FROM s
      UNION ALL SELECT min(lv) + 1, pos // 2, (min(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY pos // 2),
r AS (SELECT h AS root, lv AS depth FROM u WHERE n = 1),
w AS (SELECT l.rid, i AS step, (l.pos >> i) %% 2 AS odd, t.h FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang, unnest(range(0, s.depth)) AS x(i)
      LEFT JOIN t ON t.lang IS NOT DISTINCT FROM l.lang AND t.lv = i AND t.pos = xor(l.pos >> i, 1)
      UNION ALL SELECT l.rid, 1000 + i, (s.pos >> i) %% 2, u.h FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang, r, unnest(range(0, r.depth)) AS x(i)
      LEFT JOIN u ON u.lv = i AND u.pos = xor(s.pos >> i, 1)),
p AS (SELECT rid, sha256(coalesce(string_agg(h, '' ORDER BY step), '')) AS proof, list(odd || coalesce(h, '') ORDER BY step) AS way FROM w GROUP BY rid),
o AS (SELECT l.*, s.h AS subroot, r.root, coalesce(p.proof, sha256('')) AS proof_sha256, list_reduce([l.other] || coalesce(p.way, []),
        lambda a, x: sha256(CASE WHEN length(x) = 1 THEN a WHEN x[1] = '1' THEN x[2:] || a ELSE a || x[2:] END)) AS folded_root
      FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang CROSS JOIN r LEFT JOIN p ON p.rid = l.rid)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM o
"""
_OP13 %= {
    name: " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values)
    for name, values in {"head": ["doc_id::VARCHAR", "source", "lang"], "n": ["n_chars::VARCHAR"], "told": ["(n_chars + told)::VARCHAR"], "text": ["text"]}.items()
}

ORACLE_SQL: dict[str, str] = {"op2_threshold_topk": _OP2, "op3_mix_sources": _OP3, "op4_near_duplicates": _OP4, "op10_pii": _op10(), "op13_merkle_manifest": _OP13}
