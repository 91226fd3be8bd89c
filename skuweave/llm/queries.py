"""The registered queries of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, collocations, decontaminate, exact_dedup, language_id, licenses, mixing, prefix_trie, quality, secret_scan, set_join, suffix_dedup, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def curriculum(rank):
    """Weights 1, 2, 3, repeating by rank: sources of odd rank rise from half to one and a half of it, the others fall."""
    weight = ((rank - 1) % 3 + 1).cast("double")
    knot = lambda t, w: F.struct(F.lit(t).alias("t"), (weight * w).alias("w"))
    slope = F.when(rank % 2 == 1, 0.5).otherwise(-0.5)
    return F.array(knot(0.0, 1 - slope), knot(0.5, F.lit(1.0)), knot(1.0, 1 + slope))


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = mixing.in_training_order(mixing.assign(table(spark, sf_dir, "documents"), curriculum))
    return assigned.select("doc_id", "size", "source", "source_size", "target", "taken", F.size("copies").alias("n_copies"), "position")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), min_len=10).drop("text")
    hits = decontaminate.hit_words()
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), hits.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("item_ids")), 256).alias("items_sha256"), (hits > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spots AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT s.doc_id, s.i, s.n, win.item_id FROM spots s JOIN win ON s.g = win.g AND s.n = win.n),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n_hit, 0) AS n_hit, coalesce(ids.n_items, 0) AS n_items,
  coalesce(ids.s, sha256('')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("detections", lambda d: d["base"])
    kept = F.filter("detections", lambda d: d["kept"])
    named = lambda rows: F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda d: d["label"]))), ",")
    starts = F.transform(base, lambda d: d["start"].cast("long"))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        named(base).alias("base_labels"), named(kept).alias("labels"),
        F.coalesce(F.array_max(F.transform(kept, lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted are the documents labelled as good and not toxic."""
    trusted = table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0").select("doc_id")
    return quality.classify(table(spark, sf_dir, "documents"), trusted)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda rows: F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE))
    return found.select("doc_id", *map(count, secret_scan.BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op9_sql() -> str:
    """The matches of each rule with the pieces before them, whose lengths add up to places."""
    one = """SELECT doc_id, {place} AS place, '{kind}' AS kind, k, length(ms[k]) AS m, length(ps[k]) AS p, length(gs[k]) AS gap FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k
  FROM (SELECT doc_id, regexp_extract_all(t, '{regex}') AS ms, regexp_extract_all(t, '{regex}', {part}) AS ps, regexp_split_to_array(t, '{regex}') AS gs FROM d WHERE regexp_matches(t, '{regex}')))"""
    rows = "\nUNION ALL ".join(one.format(place=i, kind=kind, regex=regex.replace("'", "''"), part=part) for i, (kind, regex, part, _) in enumerate(secret_scan.RULES))
    least = ", ".join(f"({i}, {least})" for i, (_, _, _, least) in enumerate(secret_scan.RULES))
    base = ", ".join(f"'{k}'" for k in secret_scan.BASE)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), least(place, n) AS (VALUES {least}), hits AS ({rows}),
placed AS (SELECT doc_id, place, kind, m, p, sum(gap + m) OVER (PARTITION BY doc_id, place ORDER BY k) - m AS a FROM hits),
spans AS (SELECT doc_id, place, kind, a, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + m AS BIGINT) AS span FROM placed JOIN least USING (place) WHERE p >= n),
shown AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY a, place) FILTER (kind IN ({base})), '')) AS base_sha256, string_agg(span, ',' ORDER BY a, place) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN shown USING (doc_id)"""


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with its words that lie in passages of 50 words and more that occur elsewhere, and its class."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_dedup.repeats(docs, min_len=50)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    found = found.select("doc_id", "n_repeated", F.size("spans").alias("n_spans"), spans.alias("spans"), "class_id")
    out = docs.select("doc_id").join(found, "doc_id", "left")
    return out.select("doc_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_repeated", "n_spans")), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("class_id", "doc_id").alias("class_id"))


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
again AS (SELECT g, min(doc_id) AS rep FROM win GROUP BY g HAVING count(*) > 1),
hit AS (SELECT doc_id, i, rep FROM win JOIN again USING (g)),
marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS head FROM hit),
numbered AS (SELECT doc_id, i, sum(head) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM marked),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM numbered GROUP BY doc_id, k),
shown AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_repeated, CAST(count(*) AS INTEGER) AS n_spans, string_agg(a || '-' || z, ',' ORDER BY a) AS spans FROM spans GROUP BY doc_id),
links AS (SELECT DISTINCT doc_id AS x, rep AS y FROM hit WHERE doc_id <> rep), ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, ways.y FROM reach JOIN ways ON reach.b = ways.x)
SELECT d.doc_id, coalesce(n_repeated, 0) AS n_repeated, coalesce(n_spans, 0) AS n_spans, coalesce(spans, '') AS spans, c.class_id
FROM d LEFT JOIN shown USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a) c USING (doc_id)
"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.archived(table(spark, sf_dir, "pages"), min_bytes=0)
    return got.select(F.col("source_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
bits AS (SELECT page_id, octet_length(encode(h)) AS n, list_transform(range(0, 20), lambda i: ('0x' || substr(s, CAST(2 * i + 1 AS INTEGER), 2))::INTEGER) AS b FROM p),
dig AS (SELECT page_id, n, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(((b[i * 5 // 8 + 1] * 256 + coalesce(b[i * 5 // 8 + 2], 0)) >> (11 - i * 5 % 8)) % 32 + 1 AS INTEGER), 1)), '') AS digest FROM bits),
g AS (SELECT digest, n, max(page_id) AS first FROM dig GROUP BY digest, n)
SELECT page_id, CAST(dig.n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM dig JOIN g USING (digest, n)
"""


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.join(table(spark, sf_dir, "documents"), k=3, percent=90)


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + least(len(w), 3) - 1], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM met JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)), ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, ways.y FROM reach JOIN ways ON reach.b = ways.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = language_id.learn(docs.filter(~language_id.held_out()))
    found = language_id.predict(docs.select("doc_id", "text"), prototypes, keep_text=False)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In two batches, of which the second meets the index."""
    return exact_dedup.dedup_in_batches(table(spark, sf_dir, "documents").select("doc_id", "text"), exact_dedup.DigestIndex(spark))


OP10_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation -1 holds the template's own control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "<|im_end|><|im_start|>assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.format_conversations(rows.unionByName(own)), in_order=True)


OP11_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
e AS (SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS shown, replace(regexp_replace(role, '<(\\*)(n?)\|', '<\\\1\2|', 'g'), chr(10), '<n|') AS named FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(named) + 1 + length(shown) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), threshold=100, max_words=5, top=2000)


OP12_SQL = r"""
WITH p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM p, range(1, 6) t(size) WHERE len(w) >= size))
  GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
cuts AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM f WHERE size >= 2),
scored AS (SELECT c.lang, c.size, c.phrase, c.a, c.k, l.f AS l, r.f AS r, n, CAST((1000::HUGEINT * c.a * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score FROM cuts c JOIN totals USING (lang)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.lang = b.lang AND g.size > b.size AND 100 * g.f >= 100 * b.a AND contains(' ' || g.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept QUALIFY rank <= 2000
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations")).drop("turn_of", "turn_at")


def op13_sql() -> str:
    """crc32 of decimal ids by its table of 256 numbers, itself made by eight steps for each."""
    return r"""
WITH RECURSIVE bits AS (SELECT i AS x, i AS v, 0 AS k FROM range(0, 256) t(i) UNION ALL SELECT x, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY x) AS t FROM bits WHERE k = 8),
r AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, c - c % 20 AS b, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda a, s: xor(a >> 8, t[CAST(xor(a & 255, s) + 1 AS INTEGER)])), 4294967295) % 4 AS h
  FROM (SELECT c, count(*) AS n FROM r GROUP BY c), crc),
heads AS (SELECT ids.c, r.i AS d, r.role, r.text FROM ids JOIN r ON r.c = ids.b AND r.i <= ids.h), g AS (SELECT c, count(*) AS g FROM heads GROUP BY c),
built AS (SELECT * FROM heads UNION ALL SELECT r.c, coalesce(g.g, 0) + r.i - ids.h, r.role, r.text FROM r JOIN ids USING (c) LEFT JOIN g USING (c) WHERE r.i > ids.h),
steps AS (SELECT c, d, len(list_filter(regexp_split_to_array(text, '[ 	-
]+'), lambda w: w <> '')) AS words, sha256(string_agg(sha256(role) || sha256(text), '' ) OVER (PARTITION BY c ORDER BY d)) AS key FROM built
  UNION ALL SELECT c, 0, 0, '' FROM ids),
nodes AS (SELECT d, key, min(c) AS c, count(*) AS n, any_value(words) AS words FROM steps GROUP BY d, key),
up AS (SELECT nodes.*, p.key AS parent_key, pn.c AS parent FROM nodes LEFT JOIN steps p ON p.c = nodes.c AND p.d = nodes.d - 1 LEFT JOIN nodes pn ON pn.d = p.d AND pn.key = p.key),
kids AS (SELECT d - 1 AS d, parent_key AS key, count(*) AS n_children FROM up WHERE d > 0 GROUP BY ALL),
flags AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN kids USING (d, key)),
sums AS (SELECT a.d, a.key, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n - 1) * f.words) AS saved FROM flags f JOIN steps a ON a.c = f.c AND a.d <= f.d GROUP BY a.d, a.key),
ends AS (SELECT d, key, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS e FROM (SELECT c, max(d) AS d, arg_max(key, d) AS key FROM steps GROUP BY c) GROUP BY d, key)
SELECT c AS conv_id, d AS depth, parent AS parent_conv_id, n AS n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(e, '')) AS ends_sha256
FROM flags JOIN sums USING (d, key) LEFT JOIN ends USING (d, key)
"""


QUERIES = {"op12_collocations": op12_collocations, "op13_prefix_trie": op13_prefix_trie, "op11_chat_format": op11_chat_format, "op1_mix": op1_mix, "op2_decontaminate": op2_decontaminate, "op3_licenses": op3_licenses, "op4_suffix_dedup": op4_suffix_dedup, "op5_warc": op5_warc, "op6_jaccard_join": op6_jaccard_join, "op7_language": op7_language, "op8_quality": op8_quality, "op9_secrets": op9_secrets, "op10_exact_dedup": op10_exact_dedup}
SQL = {"op12_collocations": OP12_SQL, "op13_prefix_trie": op13_sql(), "op11_chat_format": OP11_SQL, "op2_decontaminate": OP2_SQL, "op4_suffix_dedup": OP4_SQL, "op6_jaccard_join": OP6_SQL, "op9_secrets": op9_sql(), "op5_warc": OP5_SQL, "op10_exact_dedup": OP10_SQL}
