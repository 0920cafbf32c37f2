"""The registered queries of these operators, and the SQL they are checked against.

Each query derives the columns of its contract from the operator's real outputs (texts, ids, spans, records).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import bpe, chat, decontaminate, fertility, merkle, minhash, negatives, secrets, urls, warc, weak_quality, winnow, wordpiece
from tallyline.llm.common import worker_path

#: Host, path and verdict of the URL rules.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_weak_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's score and whether it is kept."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return weak_quality.score(docs, weak_quality.fit(docs)).select("doc_id", "score", "kept")


def op2_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Turns and loss text read back from the formatted conversations."""
    text = chat.END + chat.START + "assistant ok"
    control = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, chat.ASSISTANT, text)], "conv_id long, turn long, role string, text string")
    every = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(control)
    formatted = chat.format_conversations(every).select("conv_id", "formatted", "starts", "ends", "loss_mask")
    worker_path(formatted)

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(len(batch)):
                conv, text, *spans = (batch.column(c)[i].as_py() for c in ("conv_id", "formatted", "starts", "ends", "loss_mask"))
                turns = chat.read_turns(text)
                loss = "".join(chat.under_mask(text, *spans))
                whole = "".join(f"{role}\n{body}\n" for role, body in turns)
                digests = (hashlib.sha256(x.encode()).hexdigest() for x in (whole, loss))
                rows.append((conv, len(turns), next(digests), len(loss), next(digests), len(text)))
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    schema = ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in zip(names, kinds))
    return formatted.mapInArrow(read_back, schema)


def op3_fertility_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, measures and verdict of every document."""
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    judged = fertility.judge_ids(docs, id="doc_id")
    return judged.select("doc_id", *fertility.COUNTS, "base_failed", "kept", *fertility.MEASURES)


def op4_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document, and the text that they decode to."""
    decoded = bpe.round_trip(_table(spark, folder, "documents").select("doc_id", "text"), keep_text=False)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Hit words and items of every document."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, _table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op6_warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The records read back from the archives of all pages."""
    records = warc.payload_records(_table(spark, folder, "pages"))
    place = warc.archive_folder(records)
    found = warc.read(warc.write(records, place), place)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of every document."""
    found = secrets.scan(_table(spark, folder, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(list(secrets.PATTERNS)))
    return found.select(
        "doc_id",
        *(of(kind).alias(f"n_{kind}") for kind in secrets.PATTERNS),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


def op8_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    pages = _table(spark, folder, "pages").select("page_id", "url")
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return urls.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Words and greedy longest-match tokens of every document."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return wordpiece.token_counts(docs).select("doc_id", "n_words", "n_tokens")


def op10_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's component of documents with similar sets of two-word shingles."""
    return minhash.near_duplicates(_table(spark, folder, "documents"), size=2, percent=80).drop("text_hash")


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Ranked hard negatives of the positives of every hundredth vector."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's leaf, proof and roots, and whether its row of a later time still folds to the root."""
    docs = _table(spark, folder, "documents")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    n_chars = F.when(tampered, F.col("n_chars").cast("decimal(38,0)") + 1).otherwise(F.col("n_chars").cast("decimal(38,0)"))
    later = [F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")]
    made = merkle.manifest(docs, altered=later)
    return (
        made.withColumn("folded_root", merkle.folded(F.col("altered_leaf"), F.col("proof")))
        .select(
            F.col("id").alias("doc_id"),
            "leaf",
            "subroot",
            "root",
            merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
            "folded_root",
            (F.col("folded_root") == F.col("root")).alias("verified"),
        )
    )


def op13_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and their likeness, also to the next document's."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return winnow.compare_edits(docs).select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        winnow.listed("hashes", "positions").alias("fingerprint"),
        winnow.listed("edited_hashes", "edited_positions").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_weak_quality,
        op2_chat_format,
        op3_fertility_rules,
        op4_bpe_round_trip,
        op5_decontaminate,
        op6_warc_round_trip,
        op7_secret_scan,
        op8_url_rules,
        op9_token_counts,
        op10_near_duplicates,
        op11_hard_negatives,
        op12_merkle_manifest,
        op13_fingerprints,
    )
}

_CONTROL = r"'<|im_end|><|im_start|>assistant ok'"
_FIELD = "coalesce(strlen({0}) || ':' || {0}, '-')"
_LEAF = "sha256(concat(" + ", ".join(_FIELD.format(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST({n} AS VARCHAR)", "text")) + "))"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op5_decontaminate": rf"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(list_slice(w, i, i + 12), ' ') AS gram
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM items WHERE len(w) > 0)
),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM docs, sizes WHERE len(w) >= size)
),
found AS (SELECT g.doc_id, g.size, g.i, x.item_id FROM grams g JOIN windows x USING (size, gram)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM found) GROUP BY doc_id
),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(l.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l.items, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hit h USING (doc_id) LEFT JOIN listed l USING (doc_id)
""",
    "op6_warc_round_trip": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN strlen(html) >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(html) >= 1000 AND page_id < last THEN last END AS refers_to
FROM q
""",
    "op8_url_rules": r"""
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
),
r (rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
    ('net', '/es/', 'block'), ('net', '/fr/', 'block')
),
fits AS (
  SELECT page_id, rule_host || rule_path AS rule, rule_verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, rule_host || rule_path) AS place
  FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.rule_verdict, 'allow') AS verdict
FROM p LEFT JOIN fits f ON f.page_id = p.page_id AND f.place = 1
""",
    "op10_near_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 1), ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 1))) AS i FROM w WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
),
links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach (doc_id, other) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other
),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
""",
    "op11_hard_negatives": r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q, row_number() OVER () AS place
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
),
scores AS (
  SELECT a.vec_id AS anchor_id, a.place, a.label = b.label AS same, b.vec_id AS other, b.place AS other_place,
    CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.place <> b.place
),
positives AS (
  SELECT * FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY place ORDER BY score DESC, other, other_place) <= 5
),
negatives AS (
  SELECT p.anchor_id, p.other AS positive_id, p.score AS positive_score, n.other AS negative_id, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.place, p.other_place ORDER BY n.score DESC, n.other, n.other_place) AS rank
  FROM positives p JOIN scores n ON n.place = p.place AND NOT n.same
    AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 10
""",
    "op12_merkle_manifest": rf"""
WITH RECURSIVE d AS (
  SELECT *, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, step: xor(x >> 1, 3988292384 * (x & 1)))) AS register
  FROM documents
),
l AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('1' || lang, '0') AS g, {_LEAF.format(n="n_chars")} AS leaf,
    {_LEAF.format(n="(n_chars + CASE WHEN xor(register, 4294967295) % 7 = 0 THEN 1 ELSE 0 END)")} AS later
  FROM d
),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM l),
nodes AS (
  SELECT g, 0 AS level, idx, leaf AS h FROM leaves
  UNION ALL
  SELECT g, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM nodes) WHERE n > 1 GROUP BY g, level, idx // 2
),
sub AS (
  SELECT *, row_number() OVER (ORDER BY g) - 1 AS place
  FROM (SELECT g, max(level) AS depth, arg_max(h, level) AS subroot FROM nodes GROUP BY g)
),
upper AS (
  SELECT 0 AS level, place AS idx, subroot AS h FROM sub
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER () AS n FROM upper) WHERE n > 1 GROUP BY level, idx // 2
),
top AS (SELECT max(level) AS height, arg_max(h, level) AS root FROM upper),
steps AS (
  SELECT r, step, step < depth AS inside, CASE WHEN step < depth THEN idx >> step ELSE place >> (step - depth) END AS at, g, depth
  FROM (SELECT l.r, l.g, l.idx, s.depth, s.place, unnest(generate_series(0, s.depth + t.height - 1)) AS step
        FROM leaves l JOIN sub s USING (g), top t WHERE s.depth + t.height > 0)
),
path AS (
  SELECT s.r, s.step, s.at % 2 AS odd, coalesce(n.h, u.h, '') AS sibling
  FROM steps s
  LEFT JOIN nodes n ON s.inside AND n.g = s.g AND n.level = s.step AND n.idx = xor(s.at, 1)
  LEFT JOIN upper u ON NOT s.inside AND u.level = s.step - s.depth AND u.idx = xor(s.at, 1)
),
fold AS (
  SELECT r, CAST(0 AS BIGINT) AS step, later AS h FROM leaves
  UNION ALL
  SELECT f.r, f.step + 1, sha256(CASE WHEN p.odd = 1 THEN p.sibling || f.h ELSE f.h || p.sibling END)
  FROM fold f JOIN path p ON p.r = f.r AND p.step = f.step
),
ends AS (SELECT r, arg_max(h, step) AS folded_root FROM fold GROUP BY r),
proof AS (SELECT r, string_agg(sibling, '' ORDER BY step) AS siblings FROM path GROUP BY r)
SELECT l.doc_id, l.leaf, s.subroot, t.root, sha256(coalesce(p.siblings, '')) AS proof_sha256, e.folded_root, e.folded_root = t.root AS verified
FROM leaves l JOIN sub s USING (g) JOIN ends e USING (r) LEFT JOIN proof p USING (r), top t
""",
    "op13_fingerprints": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
p AS (
  SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS following,
    coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id
  FROM t WINDOW w AS (ORDER BY doc_id DESC)
),
e AS (SELECT *, left(text, n - n // 2) || left(following, n // 2) AS edited FROM p),
every AS (
  SELECT doc_id, 0 AS kind, text AS x, n FROM e UNION ALL SELECT doc_id, 1, edited, length(edited) FROM e
),
chars AS (
  SELECT doc_id, kind, n, unnest(generate_series(0, n - 1)) AS pos,
    unnest(list_transform(string_split(x, ''), lambda c: CAST(unicode(c) AS BIGINT))) AS h
  FROM every WHERE n > 0
),
whole AS (
  SELECT doc_id, kind, n, CAST(0 AS BIGINT) AS pos,
    list_reduce(list_transform(string_split(x, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda a, b: (a * {winnow.BASE} + b) % {winnow.PRIME}) AS h
  FROM every WHERE n BETWEEN 1 AND {winnow.GRAM - 1}
),
h2 AS (SELECT doc_id, kind, n, pos, (h * {winnow.BASE} + lead(h, 1) OVER w) % {winnow.PRIME} AS h FROM chars WINDOW w AS (PARTITION BY doc_id, kind ORDER BY pos)),
h4 AS (SELECT doc_id, kind, n, pos, (h * {pow(winnow.BASE, 2, winnow.PRIME)} + lead(h, 2) OVER w) % {winnow.PRIME} AS h FROM h2 WINDOW w AS (PARTITION BY doc_id, kind ORDER BY pos)),
h8 AS (SELECT doc_id, kind, n, pos, (h * {pow(winnow.BASE, 4, winnow.PRIME)} + lead(h, 4) OVER w) % {winnow.PRIME} AS h FROM h4 WINDOW w AS (PARTITION BY doc_id, kind ORDER BY pos)),
h16 AS (SELECT doc_id, kind, n, pos, (h * {pow(winnow.BASE, 8, winnow.PRIME)} + lead(h, 8) OVER w) % {winnow.PRIME} AS h FROM h8 WINDOW w AS (PARTITION BY doc_id, kind ORDER BY pos)),
grams AS (
  SELECT doc_id, kind, pos, h, n - {winnow.GRAM - 1} AS m FROM h16 WHERE pos <= n - {winnow.GRAM}
  UNION ALL SELECT doc_id, kind, pos, h, 1 FROM whole
),
least AS (
  SELECT doc_id, kind, pos, m, min(h * 4294967296 + (4294967295 - pos)) OVER (
    PARTITION BY doc_id, kind ORDER BY pos ROWS BETWEEN CURRENT ROW AND {winnow.WINDOW - 1} FOLLOWING) AS k
  FROM grams
),
kept AS (
  SELECT DISTINCT doc_id, kind, k >> 32 AS h, 4294967295 - (k & 4294967295) AS pos
  FROM least WHERE pos <= m - least({winnow.WINDOW}, m)
),
made AS (
  SELECT doc_id, kind, string_agg(h || ':' || pos, ',' ORDER BY pos) AS listed, list(DISTINCT h) AS hashes FROM kept GROUP BY doc_id, kind
),
f AS (
  SELECT e.doc_id, e.n, e.edited, e.next_id, coalesce(a.listed, '') AS fingerprint, coalesce(b.listed, '') AS edited_fingerprint,
    coalesce(a.hashes, []) AS a, coalesce(b.hashes, []) AS b, coalesce(c.hashes, []) AS c
  FROM e LEFT JOIN made a ON a.doc_id = e.doc_id AND a.kind = 0
  LEFT JOIN made b ON b.doc_id = e.doc_id AND b.kind = 1
  LEFT JOIN made c ON c.doc_id = e.next_id AND c.kind = 0
),
shared AS (SELECT *, len(list_intersect(a, b)) AS ab, len(list_intersect(a, c)) AS ac FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint,
  CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE CAST(ab AS DOUBLE) / (len(a) + len(b) - ab) END AS near_edited,
  CASE WHEN len(a) + len(c) = 0 THEN 1.0 ELSE CAST(ac AS DOUBLE) / (len(a) + len(c) - ac) END AS near_next
FROM shared
""",
}
