"""Registered queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.llm.common import table
from cambium.llm.embedding_dedup import embedding_groups
from cambium.llm.filter_audit import filter_audit
from cambium.llm.language_id import identify_languages
from cambium.llm.license_scan import BASE, NOTICES, license_scan
from cambium.llm.line_dedup import line_dedup
from cambium.llm.mixing import mix_sources
from cambium.llm.packing import pack
from cambium.llm.quality import score_quality
from cambium.llm.simhash import simhash_groups
from cambium.llm.spelling_variants import spelling_variants
from cambium.llm.substring_dedup import remove_repeats
from cambium.llm.topk_search import top_k
from cambium.llm.warc import round_trip


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "mix.block", "mix.slot", "mix.at")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("lines.kept", 256).alias("kept_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "language.*")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return scored.select("doc_id", "quality_of.*")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return found.select("doc_id", *[f"licences.{c}" for c in columns])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_line_dedup,
        op3_language_id,
        op4_topk_search,
        op5_quality,
        op6_warc,
        op7_embedding_dedup,
        op8_substring_dedup,
        op9_simhash,
        op10_packing,
        op11_spelling_variants,
        op12_filter_audit,
        op13_license_scan,
    )
}



def _license_sql() -> str:
    """All places at which a template's first mandatory phrase begins, kept where all of its phrases stand."""
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = []
    for number, template in enumerate([*BASE, *NOTICES]):
        phrases = template.mandatory()
        held = ", ".join(f"{{'place': {at}, 'words': {listed(words)}}}" for at, words in phrases)
        rows.append(f"({number}, '{template.label}', {number < len(BASE)}, {phrases[0][0]}, '{phrases[0][1][0]}', [{held}], {listed(template.words)})")
    return rf"""
        WITH template(number, label, base, place, word, phrases, ws) AS (VALUES {", ".join(rows)}), split AS (
            SELECT doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
            FROM documents
        ), word AS (
            SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM split
        ), begin AS (
            SELECT doc_id, template.*, pos - place AS spot FROM word JOIN template USING (word)
        ), found AS (
            SELECT begin.*, list_sum(list_transform(range(len(ws)), lambda i: CASE WHEN spot + i >= 0 AND words[spot + i + 1] = ws[i + 1] THEN 1 ELSE 0 END)) / len(ws) AS share
            FROM begin JOIN split USING (doc_id)
            WHERE list_bool_and(list_transform(phrases, lambda p: spot + p.place >= 0 AND words[spot + p.place + 1 : spot + p.place + len(p.words)] = p.words))
        ), summed AS (
            SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(spot) FILTER (WHERE base) AS first_word, max(spot) FILTER (WHERE base) AS last_word,
                   string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
                   CAST(max(share) AS DOUBLE) AS score
            FROM found GROUP BY doc_id
        )
        SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
               coalesce(labels, '') AS labels, coalesce(score, 0) AS score
        FROM split LEFT JOIN summed USING (doc_id)
    """


_BLANKS = r"[\x20\x09-\x0D]"

ORACLE = {
    "op13_license_scan": _license_sql(),
    # crc32 bit by bit over the bytes of each run; words one letter apart meet where one letter of either, or of both at one place, is left out
    "op11_spelling_variants": """
        WITH RECURSIVE run AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
        ), counted AS (
            SELECT doc_id, run, count(*) AS n FROM run GROUP BY ALL
        ), bytes AS (
            SELECT *, flatten(list_transform(string_split(doc_id || ':' || run, ''),
                lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS b FROM counted
        ), hashed AS (
            SELECT doc_id, run, n, xor(4294967295, list_reduce(
                list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(b, lambda x: [CAST(x AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
                lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)))) AS h FROM bytes
        ), damaged AS (
            SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
        ), word AS (
            SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
        ), cut AS (
            SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM word, range(1, length(word) + 1) r(i)
        ), near AS (
            SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM cut a JOIN word b ON a.rest = b.word
            UNION SELECT b.word, a.word, a.n FROM cut a JOIN word b ON a.rest = b.word
        ), best AS (
            SELECT word, count(*) AS n_near, max(n) AS form_n, arg_min(other, (-n, other)) AS form FROM near GROUP BY word
        ), formed AS (
            SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n
            FROM word LEFT JOIN best USING (word)
        ), walk AS (
            SELECT word, word AS spot, form FROM formed UNION ALL SELECT walk.word, walk.form, formed.form FROM walk JOIN formed ON formed.word = walk.form
        )
        SELECT formed.word, formed.form, walk.spot AS root, n, n_near, form_n FROM formed JOIN walk ON walk.word = formed.word AND walk.form IS NULL
    """,
    "op12_filter_audit": r"""
        WITH flagged AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
        ), failing AS (
            SELECT part, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic, list_filter([
                CASE WHEN len(words) < 100 THEN 'A' END, CASE WHEN 100 * list_unique(words) < 80 * len(words) THEN 'B' END,
                CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' END,
                CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
                CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' END], lambda f: f IS NOT NULL) AS fails
            FROM flagged LEFT JOIN labels l USING (doc_id)
        ), counted AS (
            SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM failing GROUP BY ALL
        ), letter(f) AS (
            VALUES ('A'), ('B'), ('C'), ('D'), ('E')
        ), ordered AS (
            SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letter a, letter b, letter c, letter d, letter e
            WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
        ), step AS (
            SELECT filter_order, CAST(s AS INTEGER) AS step, filter_order[s] AS f, string_split(left(filter_order, s - 1), '') AS before FROM ordered, range(1, 6) r(s)
        ), audited AS (
            SELECT part, filter_order, step, f,
                   coalesce(sum(n) FILTER (WHERE NOT list_contains(fails, f) AND NOT list_has_any(fails, before)), 0) AS kept,
                   coalesce(sum(n) FILTER (WHERE list_contains(fails, f) AND NOT list_has_any(fails, before)), 0) AS removed,
                   coalesce(sum(n) FILTER (WHERE list_contains(fails, f) AND list_has_any(fails, before)), 0) AS redundant,
                   coalesce(sum(n) FILTER (WHERE fails = [f]), 0) AS unique_fails,
                   coalesce(sum(good) FILTER (WHERE list_contains(fails, f) AND NOT list_has_any(fails, before)), 0) AS good_lost,
                   coalesce(sum(toxic) FILTER (WHERE list_contains(fails, f) AND NOT list_has_any(fails, before)), 0) AS toxic_lost
            FROM counted, step GROUP BY ALL
        )
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
        FROM audited
    """,
    "op4_topk_search": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op6_warc": """
        WITH page AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), judged AS (
            SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS head FROM page
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> head THEN head END AS refers_to
        FROM judged
    """,
    "op7_embedding_dedup": """
        WITH RECURSIVE vector AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
        ), link AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM vector a JOIN vector b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95
        ), reached AS (
            SELECT vec_id AS a, vec_id AS b FROM vector UNION SELECT reached.a, link.b FROM reached JOIN link ON reached.b = link.a
        ), linked AS (
            SELECT a, count(*) AS n FROM link GROUP BY a
        ), component AS (
            SELECT a, min(b) AS component_id FROM reached GROUP BY a
        )
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM vector JOIN component ON component.a = vec_id LEFT JOIN linked ON linked.a = vec_id
    """,
    "op8_substring_dedup": r"""
        WITH split AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
        ), word AS (
            SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM split
        ), win AS (
            SELECT doc_id, s AS start, ws[s : s + 19] AS w FROM split, range(1, len(ws) - 18) r(s)
        ), nth AS (
            SELECT doc_id, start, row_number() OVER (PARTITION BY w ORDER BY doc_id, start) AS n FROM win
        ), span AS (
            SELECT doc_id, start AS pos, 1 AS step FROM nth WHERE n > 1 UNION ALL SELECT doc_id, start + 20, -1 FROM nth WHERE n > 1
        ), step AS (
            SELECT doc_id, pos, sum(step) AS step FROM span GROUP BY ALL
        ), depth AS (
            SELECT word.*, sum(coalesce(step, 0)) OVER (PARTITION BY word.doc_id ORDER BY word.pos) AS depth
            FROM word LEFT JOIN step ON step.doc_id = word.doc_id AND step.pos = word.pos
        ), kept AS (
            SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE depth > 0) AS n_removed,
                   coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE depth = 0), '') AS kept
            FROM depth GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM split LEFT JOIN kept USING (doc_id)
    """,
    "op2_line_dedup": rf"""
        WITH split AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents
        ), line AS (
            SELECT doc_id, unnest(all_lines) AS line, generate_subscripts(all_lines, 1) AS pos FROM split
        ), keyed AS (
            SELECT doc_id, pos, line,
                   translate(regexp_replace(regexp_replace(line, '^{_BLANKS}+', ''), '{_BLANKS}+$', ''),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM line
        ), shared AS (
            SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
            GROUP BY key HAVING count(DISTINCT doc_id) >= 5
        ), judged AS (
            SELECT doc_id, pos, line, shared.key IS NOT NULL AND doc_id <> last AS gone FROM keyed LEFT JOIN shared USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id
    """,
}
