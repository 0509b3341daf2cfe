"""The registered queries of the core, and for each the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.functions import text as tx
from groundline.operators import chunking, dialogue, events, grounding, imports, library, retrieval, structure
from groundline.operators.ordered import last_before
from groundline.session import spread, table
from groundline.streaming import claims

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "retrieval_eval"
WIDTH, TOP = 64, 8


def query(sql: str | None = None) -> Callable:
    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add


def _chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable vectors as they are read; a search counts copies of a chunk once."""
    rows = table(spark, sf_dir, "document_chunks").filter(retrieval.usable(F.col("embedding"), WIDTH))
    return rows.select(F.col("id").alias("chunk_id"), "document_id", "course_id", F.col("embedding").alias("vector"))


def _query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches: every row of embeddings whose id is divisible by 50, against all chunks."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


USABLE = """
    c AS (SELECT DISTINCT ON (id) id, document_id, course_id, physical_page_number, embedding::DOUBLE[] AS v FROM document_chunks
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    q AS (SELECT vec_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT vec_id, id, document_id, course_id, list_dot_product(v, qv) / sqrt(list_dot_product(v, v) * list_dot_product(qv, qv)) AS score FROM c, q)
"""


@query(f"WITH {USABLE} SELECT vec_id::VARCHAR AS query_id, id AS chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 12) DESC, id) AS rank FROM s) WHERE rank <= 8")
def batch_topk(spark, sf_dir):
    """The 8 best chunks of the whole library for every query vector."""
    found = retrieval.batch_top(_query_vectors(spark, sf_dir), _chunk_vectors(spark, sf_dir), TOP, WIDTH)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {USABLE}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 12) DESC, id) AS rank FROM s)
    SELECT vec_id::VARCHAR AS query_id, id AS chunk_id, row_number() OVER (PARTITION BY vec_id ORDER BY rank) AS label FROM r WHERE rank <= 8 AND score >= 0.40""")
def cutoff_labels(spark, sf_dir):
    """Labels of the retrieved chunks that reach the cutoff, which is applied after the limit."""
    found = retrieval.batch_top(_query_vectors(spark, sf_dir), _chunk_vectors(spark, sf_dir), TOP, WIDTH)
    return retrieval.labelled(found, retrieval.MODEL_CUTOFF, ("query_id",)).select("query_id", "chunk_id", "label")


@query(f"WITH {USABLE} SELECT vec_id::VARCHAR AS query_id, course_id, id AS chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, course_id ORDER BY round(score, 12) DESC, id) AS rank FROM s) WHERE rank <= 8")
def scoped_topk(spark, sf_dir):
    """Every query vector in the scope of each course: the 8 best of its chunks, or all of them if there are fewer."""
    found = retrieval.batch_top(_query_vectors(spark, sf_dir), _chunk_vectors(spark, sf_dir), TOP, WIDTH, scope="course_id")
    return found.select("query_id", "course_id", "chunk_id", "rank")


LARGEST = "SELECT document_id FROM document_chunks GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1"


@query(f"WITH {USABLE} SELECT vec_id::VARCHAR AS query_id, id AS chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 12) DESC, id) AS rank FROM s WHERE document_id = ({LARGEST})) WHERE rank <= 8")
def narrow_scope_complete(spark, sf_dir):
    """Every query vector in the scope of one document, the one with most chunks: a narrow scope is searched whole, its filter in the scan."""
    name = table(spark, sf_dir, "document_chunks").groupBy("document_id").count().orderBy(F.desc("count"), "document_id").first()
    rows = retrieval.in_scope(_chunk_vectors(spark, sf_dir), document_id=name["document_id"] if name else None)
    return retrieval.batch_top(_query_vectors(spark, sf_dir), rows, TOP, WIDTH).select("query_id", "chunk_id", "rank")


@query("""SELECT CASE WHEN embedding IS NULL THEN 'null' WHEN len(embedding) <> 64 THEN 'dimension' WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 THEN 'not finite'
    WHEN len(list_filter(embedding, lambda x: x <> 0)) = 0 THEN 'zero' ELSE 'usable' END AS verdict, count(*) AS n FROM document_chunks GROUP BY 1""")
def vector_checks(spark, sf_dir):
    """Chunk vectors by what makes them unusable."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    verdict = F.when(v.isNull(), "null").when(F.size(v) != WIDTH, "dimension").when(~finite, "not finite").when(~F.exists(v, lambda x: x != 0), "zero").otherwise("usable")
    return table(spark, sf_dir, "document_chunks").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


DOCS = "d AS (SELECT DISTINCT ON (id) * FROM course_documents)"
CHUNKS = "k AS (SELECT DISTINCT ON (id) * FROM document_chunks)"


@query(f"""WITH {DOCS}, {CHUNKS} SELECT d.subject, k.course_id, count(*) AS chunks, count(DISTINCT d.id) AS documents, sum(length(k.text))::BIGINT AS characters
    FROM k JOIN d ON k.document_id = d.id AND k.course_id = d.course_id GROUP BY 1, 2""")
def chunk_document_join(spark, sf_dir):
    """Chunks joined to their documents on both keys, counted by course; small tables come through dropDuplicates on the narrow columns."""
    chunks = library.once(table(spark, sf_dir, "document_chunks").select("id", "document_id", "course_id", F.char_length("text").cast("long").alias("n")))
    documents = library.once(table(spark, sf_dir, "course_documents")).select(F.col("id").alias("document_id"), "course_id", "subject")
    return chunks.join(documents, ["document_id", "course_id"]).groupBy("subject", "course_id").agg(F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents"), F.sum("n").alias("characters"))


@query(f"WITH {DOCS} SELECT subject, course_id, count(id) AS documents, coalesce(sum(page_count), 0)::BIGINT AS pages FROM d GROUP BY 1, 2")
def library_rollup(spark, sf_dir):
    """Documents and pages of every course."""
    return library.courses(library.once(table(spark, sf_dir, "course_documents")))


@query("""SELECT r_name AS subject, n_name AS course_id, count(c_custkey) AS documents, coalesce(sum(o.orders), 0)::BIGINT AS pages
    FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
    LEFT JOIN (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1) o ON o_custkey = c_custkey GROUP BY 1, 2""")
def library_rollup_relational(spark, sf_dir):
    """The same roll-up over a relational hierarchy; orders are counted before the join."""
    r, n, c, o = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    counted = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    joined = c.join(counted, "c_custkey", "left").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy(F.col("r_name").alias("subject"), F.col("n_name").alias("course_id")).agg(F.count("c_custkey").alias("documents"), F.coalesce(F.sum("orders"), F.lit(0)).alias("pages"))


@query(f"""WITH {DOCS} SELECT id, subject, course_id, page_count,
    coalesce(title, trim(regexp_replace(regexp_replace(regexp_extract(source_filename, '[^/]*$'), '(?i)(\\.(pdf|md|markdown|txt|xlsx|pptx|docx))+$', ''), '[_\\s]+', ' ', 'g'))) AS shown_title,
    CASE lower(regexp_extract(source_filename, '\\.([^.]+)$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'xlsx' THEN 'spreadsheet' WHEN 'md' THEN 'markdown' WHEN 'markdown' THEN 'markdown' ELSE 'text' END AS kind FROM d""")
def document_listing(spark, sf_dir):
    """Every document with the title shown and its kind."""
    return library.listing(library.once(table(spark, sf_dir, "course_documents")))


@query("""SELECT count(*) FILTER (coalesce(trim(subject) = '', true)) AS blank_subject, count(*) FILTER (coalesce(trim(course_id) = '', true)) AS blank_course,
    count(*) FILTER (coalesce(trim(source_filename) = '', true)) AS blank_filename, count(*) FILTER (NOT coalesce(regexp_full_match(checksum, '[0-9a-fA-F]{64}'), false)) AS bad_checksum,
    count(*) FILTER (NOT coalesce(page_count > 0, false)) AS bad_pages, count(*) FILTER (length(subject) > 200) AS long_subject, count(*) FILTER (trim(embedding_provider) = '') AS blank_provider FROM course_documents""")
def domain_checks(spark, sf_dir):
    """Rows against each rule of the documents table."""
    return library.violations(table(spark, sf_dir, "course_documents"))


@query("SELECT count(*) FILTER (embedding_provider IS DISTINCT FROM 'local') AS mismatches, count(*) AS documents FROM course_documents")
def provider_guard(spark, sf_dir):
    """Documents whose vectors may not be mixed with those of the configured provider."""
    return library.provider_mismatches(table(spark, sf_dir, "course_documents"), "local")


@query("SELECT m.embedding_model, m.embedding_dimensions AS declared, len(c.embedding)::INT AS width, count(*) AS n FROM embedding_schema_metadata m, document_chunks c WHERE c.embedding IS NOT NULL GROUP BY 1, 2, 3")
def schema_guard(spark, sf_dir):
    """Widths of the stored vectors beside the declared one."""
    meta = table(spark, sf_dir, "embedding_schema_metadata")
    widths = table(spark, sf_dir, "document_chunks").filter("embedding is not null").groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n"))
    return widths.select(meta.select("embedding_model").scalar().alias("embedding_model"), meta.select("embedding_dimensions").scalar().alias("declared"), "width", "n")


@query("""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(replace(text, chr(0), '')), '\\r\\n?', chr(10), 'g'),
    '[\\t\\f\\v ]+', ' ', 'g'), '(?m)^ ', '', 'g'), '(?m) $', '', 'g'), '\\n{2,}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g')) AS digest FROM documents WHERE text IS NOT NULL""")
def normalized_text(spark, sf_dir):
    """Every text in one layout, as a digest."""
    rows = spread(table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text"))
    return rows.select("doc_id", F.md5(tx.clean_lines(tx.nfc(F.col("text")))).alias("digest"))


@query("""WITH h AS (SELECT doc_id, sha256(text) AS checksum, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('subject=' || subject || chr(10) || 'course=' || course_id || chr(10) || 'source=' || coalesce(title, '')
      || chr(10) || 'sha256=' || sha256(text) || chr(10) || 'parser=5')) AS d FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, checksum, d[1:8] || '-' || d[9:12] || '-5' || d[14:16] || '-' || lower(printf('%02x', (('0x' || d[17:18])::INT & 63) | 128)) || d[19:20] || '-' || d[21:32] AS document_id FROM h""")
def checksums_ids(spark, sf_dir):
    """Content checksums and the name-based ids derived from them."""
    rows = table(spark, sf_dir, "documents").filter("text is not null")
    checksum = F.sha2("text", 256)
    return rows.select("doc_id", checksum.alias("checksum"), library.document_id(F.col("subject"), F.col("course_id"), F.coalesce("title", F.lit("")), checksum).alias("document_id"))


@query(f"""WITH {DOCS}, {CHUNKS} SELECT k.id, md5(concat_ws(' > ', nullif(d.subject, ''), nullif(d.course_id, ''), nullif(d.title, ''), nullif(k.section_title, '')) || chr(10) || chr(10) || k.text) AS digest
    FROM k JOIN d ON k.document_id = d.id AND k.course_id = d.course_id""")
def embedding_context(spark, sf_dir):
    """The embedding input of every chunk, as a digest."""
    chunks = library.once(table(spark, sf_dir, "document_chunks").select("id", "document_id", "course_id", "section_title", "text"))
    documents = library.once(table(spark, sf_dir, "course_documents")).select(F.col("id").alias("document_id"), "course_id", "subject", "title")
    joined = chunks.join(documents, ["document_id", "course_id"])
    return joined.select("id", F.md5(chunking.embedding_text(*map(F.col, ("subject", "course_id", "title", "section_title")), text=F.col("text"))).alias("digest"))


@query()
def page_chunks(spark, sf_dir):
    """Every document cleaned and packed into chunks of at most 1,000 characters with a carry of 150."""
    return chunking.page_chunks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), ("doc_id",)).select("doc_id", "position", F.char_length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


CLEAN = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(replace(text, chr(0), '')), '\\r\\n?', chr(10), 'g'),
    '[\\t\\f\\v ]+', ' ', 'g'), '(?m)^ ', '', 'g'), '(?m) $', '', 'g'), '\\n{2,}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g')"""
WHITE = "\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{1c}-\\x{1f}"


@query(rf"""WITH RECURSIVE n AS (SELECT doc_id, {CLEAN} AS t FROM documents WHERE text IS NOT NULL),
    w AS (SELECT doc_id, t, 0 AS start, 0 AS stop, false AS made FROM n WHERE t <> ''
      UNION ALL SELECT doc_id, t, CASE WHEN made THEN greatest(start + 1, stop - 150) ELSE start END, CASE WHEN made THEN NULL ELSE
          CASE WHEN start + 1000 >= length(t) THEN length(t)
            WHEN contains(substr(t, start + 501, 500), chr(10) || chr(10)) THEN start + 500 + length(regexp_extract(substr(t, start + 501, 500), '^((?s:.*))\n\n', 1))
            WHEN contains(substr(t, start + 501, 500), chr(10)) THEN start + 500 + length(regexp_extract(substr(t, start + 501, 500), '^((?s:.*))\n', 1))
            WHEN length(regexp_extract(substr(t, start + 1, 1000), '^((?s:.*)[.!?]["'')\]]*[{WHITE}]+)', 1)) >= 500 THEN start + length(regexp_extract(substr(t, start + 1, 1000), '^((?s:.*)[.!?]["'')\]]*[{WHITE}]+)', 1))
            WHEN contains(substr(t, start + 501, 500), ' ') THEN start + 500 + length(regexp_extract(substr(t, start + 501, 500), '^((?s:.*)) ', 1))
            ELSE start + 1000 END END, NOT made FROM w WHERE NOT made OR stop < length(t)),
    p AS (SELECT doc_id, start, substr(t, start + 1, stop - start) AS piece FROM w WHERE made)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS position, length(piece)::INT AS n_chars, md5(piece) AS digest FROM p WHERE regexp_matches(piece, '[^{WHITE}]')""")
def long_line_split(spark, sf_dir):
    """Every document cleaned and cut into windows of at most 1,000 characters with an overlap of 150, whatever its lines."""
    return chunking.page_windows(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), ("doc_id",)).select("doc_id", "position", F.char_length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


STOPS = ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS)
TERMS = "regexp_extract_all(strip_accents(replace(lower({0}), 'ß', 'ss')), '[\\pL\\pN_]+')"


@query(f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({TERMS.format('text')}) AS term FROM documents) WHERE length(term) > 1 GROUP BY 1")
def term_counts(spark, sf_dir):
    """Occurrences and documents of every term of the corpus."""
    return retrieval.term_counts(spread(table(spark, sf_dir, "documents").select("text")))


def _vectors(name: str, source: str, key: str) -> str:
    digest = "sha256(term)"
    return f"""
    {name}_t AS (SELECT {key}, term, count(*) AS n FROM (SELECT {key}, unnest({TERMS.format('text')}) AS term FROM {source}) WHERE length(term) > 1 AND term NOT IN ({STOPS}) GROUP BY 1, 2),
    {name}_b AS (SELECT {key}, (('0x' || {digest}[1:8])::BIGINT % 1024)::INT AS bucket, sum(CASE WHEN ('0x' || {digest}[9:10])::INT % 2 = 1 THEN 1 ELSE -1 END * (1 + ln(n))) AS w FROM {name}_t GROUP BY 1, 2),
    {name}_n AS (SELECT {key}, bucket, w / norm AS weight FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY {key})) AS norm FROM {name}_b) WHERE norm > 0 AND w <> 0),
    {name} AS (SELECT * FROM {name}_n UNION ALL SELECT {key}, (('0x' || sha256(text)[1:8])::BIGINT % 1024)::INT, 1.0 FROM {source}
               WHERE regexp_matches(text, '[^\\s\\p{{Z}}]') AND {key} NOT IN (SELECT {key} FROM {name}_n))"""


@query(f"WITH {_vectors('v', 'documents', 'doc_id')} SELECT doc_id, bucket, round(weight, 6) AS weight FROM v")
def lexical_vectors(spark, sf_dir):
    """Hashed term vectors of the corpus, as sparse rows."""
    return retrieval.lexical_vectors(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id").select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id, score, rank): the 8 documents whose vectors are closest to the passage of each evaluation item."""
    asked = table(spark, sf_dir, "eval_questions").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.lexical_top(asked, spread(table(spark, sf_dir, "documents").select("doc_id", "text")), TOP)


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """_ranked with whether a target of the item matches the document's title and text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "title", "text")
    targets = table(spark, sf_dir, "eval_questions").select(F.col("item_id").alias("query_id"), "targets")
    found = _ranked(spark, sf_dir).join(targets, "query_id").join(docs, "doc_id")
    hit = F.exists("targets", lambda t: F.contains(F.coalesce("title", F.lit("")), t["source"]) & F.contains(F.coalesce("text", F.lit("")), t["match"]))
    return found.withColumn("hit", hit)


RANKED = f"""{_vectors('qv', 'eval_questions', 'item_id')}, {_vectors('dv', 'documents', 'doc_id')},
    s AS (SELECT item_id, doc_id, round(sum(qv.weight * dv.weight), 9) AS score FROM qv JOIN dv USING (bucket) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 8),
    j AS (SELECT r.*, len(list_filter(e.targets, lambda t: contains(coalesce(d.title, ''), t.source) AND contains(coalesce(d.text, ''), t.match))) > 0 AS hit
          FROM r JOIN documents d USING (doc_id) JOIN eval_questions e USING (item_id)),
    f AS (SELECT e.item_id, min(CASE WHEN hit THEN rank END) AS rank FROM eval_questions e LEFT JOIN j USING (item_id) GROUP BY 1)"""


@query(f"WITH {RANKED} SELECT count(*) AS questions, avg(coalesce((rank <= 1)::INT, 0)) AS hit_1, avg(coalesce((rank <= 3)::INT, 0)) AS hit_3, avg(coalesce((rank <= 8)::INT, 0)) AS hit_8, round(avg(coalesce(1.0 / rank, 0)), 9) AS mrr FROM f")
def retrieval_eval(spark, sf_dir):
    """hit@1, @3, @8 and the mean reciprocal rank of lexical retrieval over the corpus, for all evaluation items in one batch."""
    first = _judged(spark, sf_dir).filter("hit").groupBy("query_id").agg(F.min("rank").alias("rank"))
    asked = table(spark, sf_dir, "eval_questions").select(F.col("item_id").alias("query_id"))
    return retrieval.rank_report(asked.join(first, "query_id", "left")).withColumn("mrr", F.round("mrr", 9))


@query(f"WITH {RANKED} SELECT hit, count(*) AS n, round(min(score), 6) AS lowest, round(median(score), 6) AS middle, round(max(score), 6) AS highest FROM j GROUP BY hit")
def score_separation(spark, sf_dir):
    """Scores of right and other passages."""
    return _judged(spark, sf_dir).groupBy("hit").agg(F.count("*").alias("n"), F.round(F.min("score"), 6).alias("lowest"), F.round(F.percentile("score", 0.5), 6).alias("middle"), F.round(F.max("score"), 6).alias("highest"))


@query(f"""WITH {DOCS}, s AS (SELECT id, CASE WHEN page_count % 2 = 0 THEN embedding_provider ELSE 'deterministic' END AS p FROM d WHERE page_count % 3 <> 0)
    SELECT id, embedding_provider FROM d WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.id = d.id AND s.p IS NOT DISTINCT FROM d.embedding_provider)""")
def skip_unchanged(spark, sf_dir):
    """Documents that an import has to work on, against a store that lacks some and holds others by another provider."""
    incoming = library.once(table(spark, sf_dir, "course_documents")).select("id", "embedding_provider", "page_count")
    stored = incoming.filter("page_count % 3 <> 0").select("id", F.when(F.col("page_count") % 2 == 0, F.col("embedding_provider")).otherwise("deterministic").alias("embedding_provider"))
    return library.unchanged(incoming.select("id", "embedding_provider"), stored)


@query(f"WITH {DOCS} SELECT id, course_id, source_filename FROM d QUALIFY row_number() OVER (PARTITION BY course_id, source_filename ORDER BY created_at DESC, id DESC) = 1")
def replace_superseded(spark, sf_dir):
    """The version of each file that stays."""
    return library.current_versions(library.once(table(spark, sf_dir, "course_documents"))).select("id", "course_id", "source_filename")


@query(f"""WITH {DOCS}, v AS (SELECT id, course_id FROM d QUALIFY row_number() OVER (PARTITION BY course_id, source_filename ORDER BY created_at DESC, id DESC) = 1)
    SELECT DISTINCT id, document_id FROM document_chunks k WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.id = k.document_id AND v.course_id = k.course_id)""")
def cascade_delete(spark, sf_dir):
    """Chunks that go when superseded versions of their files are deleted."""
    chunks = table(spark, sf_dir, "document_chunks").select("id", "document_id", "course_id").distinct()
    parents = library.current_versions(library.once(table(spark, sf_dir, "course_documents"))).select(F.col("id").alias("document_id"), "course_id")
    return library.orphans(chunks, parents, ["document_id", "course_id"]).select("id", "document_id")


@query(f"""WITH {CHUNKS}, f AS (SELECT id, document_id, chunk_position FROM k WHERE physical_page_number % 7 <> 0 OR chunk_position % 5 <> 0)
    SELECT coalesce(k.document_id, f.document_id) AS document_id, bool_and(k.id IS NOT DISTINCT FROM f.id) AS fits FROM k FULL JOIN f ON k.document_id = f.document_id AND k.chunk_position = f.chunk_position GROUP BY 1""")
def reembed_match(spark, sf_dir):
    """Whether newly made chunks fit the stored ones of each document, for a set from which some are missing."""
    stored = library.once(table(spark, sf_dir, "document_chunks").select("id", "document_id", "chunk_position", "physical_page_number"))
    return library.reembedding(stored, stored.filter("physical_page_number % 7 <> 0 or chunk_position % 5 <> 0"))


LINES = """x AS (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
    l AS (SELECT doc_id, i AS line, ((i - 1) // 10 + 1)::INT AS page, regexp_replace(parts[i], '[\\s ]+$', '') AS text FROM x, unnest(range(1, len(parts) + 1)) AS u(i))"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.numbered_lines(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id")


@query(f"WITH {LINES} SELECT doc_id, line, page, md5(text) AS digest FROM l")
def numbered_lines(spark, sf_dir):
    """Every line of every document, numbered as the viewer numbers it."""
    return _lines(spark, sf_dir).select("doc_id", "line", "page", F.md5("text").alias("digest"))


@query(f"""WITH {LINES}, g AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS island FROM l WHERE text <> '')
    SELECT doc_id, min(line) AS first_line, max(line) AS last_line, count(*) AS n_lines FROM g GROUP BY doc_id, island""")
def islands_blocks(spark, sf_dir):
    """Blocks of consecutive lines that are not blank."""
    return structure.blocks(_lines(spark, sf_dir), "doc_id")


@query(f"""WITH {LINES}, w AS (SELECT *, sum(regexp_matches(text, '^\\s*(```|~~~)')::INT) OVER (PARTITION BY doc_id ORDER BY line) % 2 AS fenced FROM l),
    h AS (SELECT doc_id, line, length(regexp_extract(text, '^(#{{1,6}})[ \\t]+\\S', 1)) AS level, regexp_replace(regexp_replace(text, '^#{{1,6}}[ \\t]+', ''), '[ \\t]*#*[ \\t]*$', '') AS heading FROM w WHERE fenced = 0 AND regexp_matches(text, '^#{{1,6}}[ \\t]+\\S')),
    a AS (SELECT h.doc_id, h.line, o.level, o.heading, o.line AS at FROM h JOIN h o ON o.doc_id = h.doc_id AND o.line <= h.line AND o.level <= h.level
          WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.doc_id = h.doc_id AND b.line > o.line AND b.line <= h.line AND b.level <= o.level))
    SELECT h.doc_id, h.line, h.level::INT AS level, h.heading, string_agg(a.heading, ' > ' ORDER BY a.level) AS path FROM h JOIN a ON a.doc_id = h.doc_id AND a.line = h.line GROUP BY 1, 2, 3, 4""")
def heading_path(spark, sf_dir):
    """Headings with the path of the headings above them."""
    return structure.headings(_lines(spark, sf_dir), "doc_id")


@query(f"""WITH {LINES}, n AS (SELECT d.course_id, l.doc_id, l.line, l.text FROM l JOIN documents d USING (doc_id) WHERE d.course_id IS NOT NULL),
    b AS (SELECT *, min(line) OVER w AS lo, max(line) OVER w AS hi FROM n WHERE text <> '' WINDOW w AS (PARTITION BY course_id, doc_id)),
    m AS (SELECT course_id, regexp_replace(lower(text), '[0-9]+', '#', 'g') AS margin, count(DISTINCT doc_id) AS pages FROM b WHERE line IN (lo, hi) GROUP BY 1, 2)
    SELECT m.* FROM m JOIN (SELECT course_id, count(DISTINCT doc_id) AS n FROM n GROUP BY 1) p USING (course_id) WHERE pages >= greatest(2, ceil(n * 0.02))""")
def boilerplate_lines(spark, sf_dir):
    """What recurs as first or last line of the documents of a course, in one of fifty or more: the margin rule with documents as pages."""
    rows = table(spark, sf_dir, "documents").filter("course_id is not null").select("course_id", "doc_id", "text")
    lines = structure.numbered_lines(rows.select(F.struct("course_id", "doc_id").alias("k"), "text"), "k").select("k.course_id", F.col("k.doc_id").alias("page"), "line", "text")
    return structure.frequent_margins(lines, "course_id", share=0.02)


@query(f"""WITH {LINES}, o AS (SELECT *, regexp_matches(text, '^\\s*[a-zA-Z][.)]\\s') AS opt FROM l),
    a AS (SELECT *, regexp_matches(text, '^\\s*[0-9]{{1,3}}[.)]\\s') AND (coalesce(lead(opt, 1) OVER w, false) OR coalesce(lead(opt, 2) OVER w, false) OR coalesce(lead(opt, 3) OVER w, false)) AS asked FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY line))
    SELECT doc_id, count(*) FILTER (asked) AS n_questions FROM a GROUP BY 1 HAVING n_questions >= 1""")
def question_split(spark, sf_dir):
    """Documents that are question sheets, with their number of questions."""
    return structure.questions(_lines(spark, sf_dir), "doc_id", 1)


@query("""WITH s AS (SELECT p_brand, p_size, sum(length(p_name))::BIGINT AS w FROM part GROUP BY 1, 2) SELECT p_brand, p_size, w AS weight FROM s QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY w DESC, p_size) = 1""")
def body_size_mode(spark, sf_dir):
    """The size that carries most characters, by brand: the rule that finds the body size of a document."""
    return structure.weighted_mode(table(spark, sf_dir, "part"), ["p_brand"], "p_size", F.length("p_name"))


@query("WITH s AS (SELECT l_returnflag, l_linenumber, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, l_linenumber, w AS weight FROM s QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY w DESC, l_linenumber) = 1")
def dominant_mode(spark, sf_dir):
    """The same weighted mode over line items."""
    return structure.weighted_mode(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linenumber", F.col("l_quantity"))


@query(f"""WITH {CHUNKS}, p AS (SELECT document_id, physical_page_number AS page, min(section_title) AS title, string_split(string_agg(text, chr(10) ORDER BY chunk_position, id), chr(10)) AS lines FROM k GROUP BY 1, 2),
    c AS (SELECT *, length(regexp_replace(array_to_string(lines, ''), '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS letters FROM p),
    n AS (SELECT *, lead(page) OVER w AS np, lead(title) OVER w AS nt, lead(lines) OVER w AS nl, lead(letters) OVER w AS nn FROM c WINDOW w AS (PARTITION BY document_id ORDER BY page)),
    f AS (SELECT * FROM n WHERE NOT coalesce(np = page + 1 AND title <> '' AND nt = title AND (len(list_filter(lines, lambda x: NOT list_contains(nl, x))) = 0 OR (letters < 20 AND nn >= 20)), false))
    SELECT document_id, page FROM f QUALIFY row_number() OVER (PARTITION BY document_id, lines ORDER BY page) = 1""")
def overlay_drop(spark, sf_dir):
    """Pages that stay when overlay steps and repeats of a page are dropped."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.xxhash64(x))
    letters = F.char_length(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))
    chunks = library.once(table(spark, sf_dir, "document_chunks").filter("text is not null").select("id", "document_id", "physical_page_number", "section_title", "chunk_position", lines.alias("lines"), letters.alias("letters")))
    pages = chunks.groupBy("document_id", F.col("physical_page_number").alias("page")).agg(
        F.min("section_title").alias("title"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk_position", "id", "lines"))), lambda x: x["lines"])).alias("lines"),
        F.sum("letters").alias("letters"),
    )
    return structure.without_overlays(pages, "document_id").select("document_id", "page")


@query(f"""WITH {CHUNKS} SELECT id, last_value(section_title IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY chunk_position, id ROWS UNBOUNDED PRECEDING) AS carried FROM k""")
def divider_sections(spark, sf_dir):
    """The section of every chunk, carried over chunks that have none."""
    chunks = library.once(table(spark, sf_dir, "document_chunks").select("id", "document_id", "chunk_position", "section_title"))
    before = last_before(chunks, ["document_id"], "chunk_position", F.col("section_title"), "id", "before")
    return before.select("id", F.coalesce("section_title", "before").alias("carried"))


@query("SELECT c_nationkey AS sheet, count(*) FILTER (regexp_matches(c_mktsegment || c_name, '[A-Za-z]')) AS text_rows, count(*) FILTER (NOT regexp_matches(c_mktsegment || c_name, '[A-Za-z]')) AS numeric_rows FROM customer GROUP BY 1")
def sheet_rows(spark, sf_dir):
    """Rows of text and of numbers alone, by sheet."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("sheet"), F.col("c_custkey").alias("row"), F.array(F.col("c_custkey").cast("string"), "c_name", "c_mktsegment", F.col("c_acctbal").cast("string")).alias("cells"))
    text = structure.sheet_rows(rows, "sheet", "row", "cells").groupBy("sheet").agg(F.count("*").alias("text_rows"))
    return structure.numeric_rows(rows, "sheet", "cells").join(text, "sheet", "left").select("sheet", F.coalesce("text_rows", F.lit(0)).alias("text_rows"), "numeric_rows")


@query(f"""WITH {CHUNKS}, e AS (SELECT id, x.p AS page, x.b AS b, x.l AS l FROM (SELECT id, length(text) AS n, unnest(locations) AS x FROM k) WHERE x.s < n AND x.e > 0)
    SELECT id, page, count(DISTINCT b) AS boxes, count(DISTINCT l) AS lines FROM e GROUP BY 1, 2""")
def highlights_by_page(spark, sf_dir):
    """Distinct boxes and lines of each page that a chunk's text stands on: what an excerpt without a verified quote shows."""
    chunks = library.once(table(spark, sf_dir, "document_chunks").select("id", "locations", F.char_length("text").alias("n")))
    located = chunks.select("id", grounding.overlapping(F.col("locations"), F.lit(0), F.col("n")).alias("locations"))
    return grounding.highlights(located, "id").select("id", "page", F.size("boxes").cast("long").alias("boxes"), F.size("lines").cast("long").alias("lines"))


MESSAGES = "m AS (SELECT DISTINCT ON (id) * REPLACE (lower(trim(role)) AS role) FROM messages WHERE conversation_id IS NOT NULL AND position IS NOT NULL)"


ALL_MESSAGES = "m AS (SELECT DISTINCT ON (id) * REPLACE (lower(trim(role)) AS role) FROM messages)"


def _all_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.once(table(spark, sf_dir, "messages").withColumn("role", F.lower(F.trim("role"))))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that have a place in a conversation."""
    rows = table(spark, sf_dir, "messages").filter("conversation_id is not null and position is not null")
    return library.once(rows.withColumn("role", F.lower(F.trim("role"))))


@query(f"""WITH {ALL_MESSAGES}, c AS (SELECT id, i AS claim, payload.claims[i].citations AS sources FROM m, unnest(range(1, len(payload.claims) + 1)) AS u(i)),
    s AS (SELECT id, claim, sources[j] AS source, j AS place FROM c, unnest(range(1, len(sources) + 1)) AS u(j)),
    u AS (SELECT id, claim, source, min(place) AS place FROM s GROUP BY 1, 2, 3),
    n AS (SELECT id, source, row_number() OVER (PARTITION BY id ORDER BY min((claim, place))) AS number FROM u GROUP BY 1, 2)
    SELECT id, (claim - 1)::INT AS claim, source, number FROM u JOIN n USING (id, source)""")
def citation_numbers(spark, sf_dir):
    """Sources of every claim, numbered by first use in their answer."""
    each = _all_messages(spark, sf_dir).select("id", F.posexplode("payload.claims").alias("claim", "c")).select("id", "claim", F.col("c.citations").alias("sources"))
    return grounding.citation_numbers(each, "id").select("id", "claim", "source", "number")


@query(f"""WITH {ALL_MESSAGES}, c AS (SELECT id, unnest(payload.citations) AS j FROM m), p AS (SELECT id, (j->>'$.number')::INT AS number, j->>'$.document_id' AS document_id FROM c)
    SELECT p.id, p.number, p.document_id, d.id IS NOT NULL AS known FROM p LEFT JOIN (SELECT DISTINCT id FROM course_documents) d ON d.id = p.document_id""")
def citation_documents(spark, sf_dir):
    """Citations parsed from JSON and looked up in the library; unknown documents stay."""
    each = _all_messages(spark, sf_dir).select("id", F.explode("payload.citations").alias("j")).select("id", F.from_json("j", "number int, document_id string, excerpt string").alias("c"))
    known = table(spark, sf_dir, "course_documents").select(F.col("id").alias("document_id")).distinct().withColumn("known", F.lit(True))
    cited = each.select("id", "c.number", "c.document_id")
    return cited.join(known, "document_id", "left").select("id", "number", "document_id", F.coalesce("known", F.lit(False)).alias("known"))


def _quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, content, number, quote) of every citation of every answer."""
    each = _all_messages(spark, sf_dir).filter("content is not null").select("id", "content", F.explode("payload.citations").alias("j"))
    return each.select("id", "content", F.from_json("j", "number int, document_id string, excerpt string").alias("c")).select("id", "content", "c.number", F.col("c.excerpt").alias("quote")).filter("quote is not null")


BARE = "regexp_replace(strip_accents(lower({0})), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


@query(f"""WITH {ALL_MESSAGES}, c AS (SELECT id, content, unnest(payload.citations) AS j FROM m), p AS (SELECT id, content, (j->>'$.number')::INT AS number, j->>'$.excerpt' AS quote FROM c)
    SELECT id, number, length({BARE.format('quote')}) >= 3 AND contains({BARE.format('content')}, {BARE.format('quote')}) AS exact FROM p WHERE content IS NOT NULL AND quote IS NOT NULL""")
def quote_verify_exact(spark, sf_dir):
    """Whether the excerpt of each citation stands in its answer, letter for letter and digit for digit."""
    found = _quoted(spark, sf_dir).select("id", "number", tx.skeleton("content").alias("c"), tx.skeleton("quote").alias("q"))
    return found.select("id", "number", ((F.char_length("q") >= grounding.LEAST) & F.contains("c", F.col("q"))).alias("exact"))


@query()
def quote_verify(spark, sf_dir):
    """Spans of the excerpts in their answers, by letters and digits, else by similarity."""
    return grounding.verified_quotes(_quoted(spark, sf_dir), "content", "quote").select("id", "number", "span.start", "span.end")


@query(f"SELECT DISTINCT id, md5({BARE.format('excerpt')}) AS digest FROM (SELECT id, unnest(payload.citations)->>'$.excerpt' AS excerpt FROM messages) WHERE excerpt IS NOT NULL")
def skeleton_text(spark, sf_dir):
    """The letters and digits of every cited excerpt, as a digest: what quotes are compared by."""
    return _quoted_all(spark, sf_dir).select("id", F.md5(tx.skeleton("quote")).alias("digest")).distinct()


def _quoted_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "messages").select("id", F.explode("payload.citations").alias("j"))
    return each.select("id", F.get_json_object("j", "$.excerpt").alias("quote")).filter("quote is not null")


@query()
def locate_lines(spark, sf_dir):
    """The source lines of every chunk sought again in its text: how many there are, how many are found, and how far their text reaches."""
    chunks = library.once(table(spark, sf_dir, "document_chunks").filter("size(locations) > 0").select("id", "text", "locations"))
    line = lambda x: F.struct(F.substring("text", x["s"] + 1, x["e"] - x["s"]).alias("text"), x["p"].alias("p"), x["b"].alias("b"), x["l"].alias("l"))
    found = grounding.located(chunks.select("id", "text", F.transform("locations", line).alias("lines"), F.size("locations").alias("n")), "text", "lines")
    return found.select("id", F.col("n").alias("lines"), F.size("locations").alias("found"), F.aggregate("locations", F.lit(0), lambda most, x: F.greatest(most, x["e"])).alias("reach"))


QUOTE = r"[.!?…][ \n]+([^.!?…]{12,})"


@query()
def citation_assembly(spark, sf_dir):
    """Every chunk with locations, cited by its second sentence: the verified quote and the pages, boxes and lines it stands on."""
    chunks = library.once(table(spark, sf_dir, "document_chunks").filter("size(locations) > 0").select("id", "text", "locations"))
    sources = chunks.select("id", F.lit(0).alias("claim"), F.lit(0).alias("place"), F.lit(1).alias("label"), F.regexp_extract("text", QUOTE, 1).alias("quote"))
    done = grounding.citations(sources, chunks.withColumn("label", F.lit(1)), "id")
    count = lambda part: F.aggregate("highlights", F.lit(0), lambda n, h: n + F.size(h[part]))
    return done.select("id", "number", F.size("quotes").alias("quotes"), F.transform("highlights", lambda h: h["page"]).alias("pages"), count("boxes").alias("boxes"), count("lines").alias("lines"))


@query(f"""WITH {MESSAGES}, s AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY position DESC, id) AS back FROM m WHERE role = 'user' OR (role = 'assistant' AND coalesce(payload.status, '') = 'answered')),
    k AS (SELECT * FROM s WHERE back <= 6) SELECT id, conversation_id, (count(*) OVER (PARTITION BY conversation_id) - back)::INT AS turn FROM k""")
def history_turns(spark, sf_dir):
    """The turns of each conversation that a follow-up may refer to."""
    return dialogue.history(_messages(spark, sf_dir)).select("id", "conversation_id", "turn")


@query(f"WITH {MESSAGES} SELECT c.id, coalesce(max(m.position), -1) + 1 AS next_position FROM (SELECT DISTINCT id FROM conversations) c LEFT JOIN m ON m.conversation_id = c.id GROUP BY 1")
def append_positions(spark, sf_dir):
    """The position that the next message of each conversation takes."""
    return dialogue.next_positions(_messages(spark, sf_dir), library.once(table(spark, sf_dir, "conversations")))


@query("""WITH f AS (SELECT id, trim(regexp_replace(title, '[\\s\\p{Z}]+', ' ', 'g')) AS t FROM (SELECT DISTINCT ON (id) * FROM conversations))
    SELECT id, CASE WHEN length(t) <= 80 THEN t ELSE rtrim(substr(t, 1, 79)) || '…' END AS short_title FROM f""")
def conversation_titles(spark, sf_dir):
    """Titles as stored for a new conversation."""
    return library.once(table(spark, sf_dir, "conversations")).select("id", tx.conversation_title(F.col("title")).alias("short_title"))


@query("SELECT id, title FROM (SELECT DISTINCT ON (id) * FROM conversations) ORDER BY updated_at DESC, id LIMIT 100")
def recent_conversations(spark, sf_dir):
    """The hundred conversations touched last: a top-k report."""
    return library.once(table(spark, sf_dir, "conversations")).orderBy(F.desc("updated_at"), "id").limit(100).select("id", "title")


@query("""WITH c AS (SELECT DISTINCT ON (id) * FROM conversations), t AS (SELECT max(updated_at)::DATE AS today FROM c)
    SELECT CASE WHEN d <= 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d < 7 THEN 'week' ELSE 'older' END AS bucket, count(*) AS n FROM (SELECT today - updated_at::DATE AS d FROM c, t) GROUP BY 1""")
def recency_buckets(spark, sf_dir):
    """Conversations by recency, seen from the day of the last change."""
    rows = library.once(table(spark, sf_dir, "conversations"))
    today = rows.agg(F.to_date(F.max("updated_at"))).scalar()
    return rows.select(dialogue.recency(F.col("updated_at"), today).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query(f"""WITH {MESSAGES}, q AS (SELECT *, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY position, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question FROM m)
    SELECT id, conversation_id, coalesce(payload.status, 'answered') AS status, CASE WHEN payload.retrieval_query IS DISTINCT FROM question THEN payload.retrieval_query END AS shown_search FROM q WHERE role = 'assistant'""")
def rewritten_searches(spark, sf_dir):
    """Assistant messages as a reopened view shows them."""
    return dialogue.restored(_messages(spark, sf_dir))


@query(f"""WITH {ALL_MESSAGES} SELECT coalesce(payload.status, 'none') AS status, count(*) AS answers, count(*) FILTER (coalesce(len(payload.citations), 0) > 0) AS with_citations, sum(coalesce(len(payload.citations), 0))::BIGINT AS citations
    FROM m WHERE role = 'assistant' GROUP BY 1""")
def answer_scorecard(spark, sf_dir):
    """Outcomes of all answers."""
    return dialogue.scorecard(_all_messages(spark, sf_dir))


@query("SELECT user_id, coalesce(bool_and(ok), true) AS valid FROM (SELECT user_id, event_type <> coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS ok FROM events) GROUP BY 1")
def event_order(spark, sf_dir):
    """Users whose events never repeat their type at once: the window that checks an event contract."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    checked = last_before(rows, ["user_id"], "at", F.col("event_type"), "event_id", "before", size=86_400_000_000).withColumn("ok", F.col("event_type") != F.coalesce("before", F.lit("")))
    return checked.groupBy("user_id").agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("valid"))


@query(f"""WITH {MESSAGES} SELECT conversation_id, count(*) AS events, bool_and(CASE WHEN before IS NULL THEN role = 'user' ELSE role <> before END) AS alternates FROM
    (SELECT *, lag(role) OVER (PARTITION BY conversation_id ORDER BY position, id) AS before FROM m WHERE role IN ('user', 'assistant')) GROUP BY 1""")
def turn_order(spark, sf_dir):
    """Conversations whose turns alternate, beginning with the user."""
    turns = _messages(spark, sf_dir).filter(F.col("role").isin("user", "assistant"))
    marked = last_before(turns, ["conversation_id"], "position", F.col("role"), "id", "before").withColumn("fine", F.when(F.col("before").isNull(), F.col("role") == "user").otherwise(F.col("role") != F.col("before")))
    return marked.groupBy("conversation_id").agg(F.count("*").alias("events"), F.bool_and("fine").alias("alternates"))


EVENTS = f"""{ALL_MESSAGES}, a AS (SELECT id, payload, payload.status AS status, coalesce(len(payload.claims), 0) AS n FROM m WHERE role = 'assistant'),
    ts AS (SELECT id, list_concat(list_concat(['conversation', 'status'], list_transform(range(n), lambda x: 'claim')),
        CASE status WHEN 'answered' THEN ['citations', 'completed'] WHEN 'abstained' THEN ['abstention'] WHEN 'error' THEN ['error'] ELSE [] END) AS kinds FROM a),
    ev AS (SELECT id, i - 1 AS seq, kinds[i] AS type FROM ts, unnest(range(1, len(kinds) + 1)) AS u(i))"""


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.told(_all_messages(spark, sf_dir).filter("role = 'assistant'").select("id", "payload"))


@query(f"""WITH {EVENTS}, w AS (SELECT *, lag(type) OVER o AS before, lead(type) OVER o IS NULL AS last FROM ev WINDOW o AS (PARTITION BY id ORDER BY seq))
    SELECT id, bool_and(CASE WHEN before IS NULL THEN type = 'conversation' WHEN before = 'conversation' THEN type IN ('status', 'abstention', 'error') WHEN before = 'status' THEN type IN ('status', 'claim', 'abstention', 'error')
      WHEN before = 'claim' THEN type IN ('claim', 'citations', 'abstention', 'error') WHEN before = 'citations' THEN type IN ('completed', 'error') ELSE false END
      AND (NOT last OR type IN ('completed', 'abstention', 'error'))) AS valid FROM w GROUP BY 1""")
def event_contract(spark, sf_dir):
    """Whether the events that each stored answer stands for follow the protocol of an answer stream."""
    return dialogue.contract_errors(_told(spark, sf_dir), "id")


@query(f"SELECT id, CASE WHEN status IS NULL OR status NOT IN ('answered', 'abstained', 'error') THEN 'no end' END AS fault FROM ({f'WITH {EVENTS} SELECT id, status FROM a'})")
def stream_faults(spark, sf_dir):
    """What a reader would reject in the streams of all stored answers, written as lines of JSON and read again."""
    return events.faults(events.as_lines(_told(spark, sf_dir)), "id")


@query(f"""WITH {EVENTS} SELECT id, CASE status WHEN 'answered' THEN 'answered' WHEN 'abstained' THEN 'abstained' WHEN 'error' THEN 'error' ELSE 'open' END AS status,
    md5(CASE WHEN status = 'abstained' THEN '' ELSE coalesce(list_reduce(list_transform(payload.claims, lambda c: c.text), lambda x, y: x || chr(10) || y), '') END) AS claims FROM a WHERE n > 0
    UNION ALL SELECT id, CASE status WHEN 'answered' THEN 'answered' WHEN 'abstained' THEN 'abstained' WHEN 'error' THEN 'error' ELSE 'open' END, md5('') FROM a WHERE n = 0""")
def shown_answers(spark, sf_dir):
    """What a reader holds after the events of each stored answer."""
    return events.shown(_told(spark, sf_dir), "id").select("id", "status", F.md5(F.array_join("claims", "\n")).alias("claims"))


@query(f"""WITH {EVENTS}, s AS (SELECT id, status AS stored, CASE WHEN status = 'answered' AND coalesce(len(payload.citations), 0) > 0 THEN 'answered' WHEN status = 'abstained' THEN 'abstained' ELSE 'error' END AS status, n, coalesce(len(payload.citations), 0) AS c FROM a)
    SELECT stored, status, count(*) AS answers, sum(CASE WHEN status = 'answered' THEN n ELSE 0 END)::BIGINT AS claims, sum(CASE WHEN status = 'answered' THEN c ELSE 0 END)::BIGINT AS citations FROM s GROUP BY 1, 2""")
def settled_answers(spark, sf_dir):
    """Stored statuses beside those that the outcome gives, with the claims and citations that stay."""
    rows = events.settled(_all_messages(spark, sf_dir).filter("role = 'assistant'").select("id", "payload"))
    return rows.groupBy("stored", "status").agg(F.count("*").alias("answers"), F.sum("claims").cast("long").alias("claims"), F.sum("citations").cast("long").alias("citations"))


@query(f"""WITH {EVENTS}, k AS (SELECT id, unnest(payload.citations)->>'$.number' AS label FROM a), c AS (SELECT id, i - 1 AS claim, trim(payload.claims[i].text) AS text, payload.claims[i].citations AS cited FROM a, unnest(range(1, n + 1)) AS u(i)),
    s AS (SELECT DISTINCT c.id, claim, text, label::INT AS label FROM c, unnest(cited) AS x(label) WHERE text <> '' AND EXISTS (SELECT 1 FROM k WHERE k.id = c.id AND k.label::INT = x.label))
    SELECT id AS answer_id, claim::INT AS claim, md5(text) AS digest, count(*)::INT AS sources FROM s GROUP BY 1, 2, 3""")
def claims_from_json(spark, sf_dir):
    """The claims of every stored answer, written as a model's JSON, cut into fragments and parsed again; labels without a citation are dropped."""
    answers = _all_messages(spark, sf_dir).filter("role = 'assistant' and size(payload.claims) > 0")
    source = lambda n: F.struct(F.concat(F.lit("S"), n.cast("string")).alias("id"))
    written = F.to_json(F.struct(F.transform("payload.claims", lambda c: F.struct(c["text"].alias("text"), F.transform(c["citations"], source).alias("sources"))).alias("claims")))
    pieces = answers.select(F.col("id").alias("answer_id"), written.alias("j")).select("answer_id", "j", F.posexplode(F.sequence(F.lit(1), F.char_length("j"), F.lit(40))).alias("seq", "at"))
    evidence = answers.select(F.col("id").alias("answer_id"), F.explode("payload.citations").alias("c")).select("answer_id", F.get_json_object("c", "$.number").cast("int").alias("label"))
    found = claims.validated(claims.parse_answers(pieces.select("answer_id", "seq", F.substring("j", F.col("at"), F.lit(40)).alias("fragment"))), evidence)
    return found.select("answer_id", "claim", F.md5("text").alias("digest"), F.size("sources").alias("sources"))


@query(f"WITH {DOCS} SELECT d.id, count(k.id) AS chunks FROM d LEFT JOIN (SELECT DISTINCT id, document_id FROM document_chunks) k ON k.document_id = d.id GROUP BY 1")
def document_chunk_counts(spark, sf_dir):
    """The chunks that the library holds of each document."""
    return imports.chunks_of(library.once(table(spark, sf_dir, "document_chunks").select("id", "document_id")), library.once(table(spark, sf_dir, "course_documents")))


@query(f"WITH {DOCS} SELECT subject, count(DISTINCT course_id) AS courses, epoch_us(min(created_at)) AS first_seen FROM d GROUP BY 1")
def subjects(spark, sf_dir):
    """The subjects of the library with their courses, by when they came."""
    return library.subjects(library.once(table(spark, sf_dir, "course_documents"))).select("subject", "courses", F.unix_micros("first_seen").alias("first_seen"))


@query(f"""WITH {DOCS}, {CHUNKS} SELECT k.id, md5(concat_ws('|', coalesce(d.course_id, ''), coalesce(d.title, d.source_filename, ''), coalesce(k.section_title, ''), k.physical_page_number::VARCHAR, k.text)) AS digest
    FROM k JOIN d ON d.id = k.document_id AND d.course_id = k.course_id""")
def prompt_payload(spark, sf_dir):
    """The fields of each excerpt as a prompt holds them, as a digest."""
    chunks = library.once(table(spark, sf_dir, "document_chunks").select("id", "document_id", "course_id", "section_title", "physical_page_number", "text"))
    documents = library.once(table(spark, sf_dir, "course_documents")).select(F.col("id").alias("document_id"), "course_id", "title", "source_filename")
    joined = chunks.join(documents, ["document_id", "course_id"])
    fields = [F.coalesce("course_id", F.lit("")), F.coalesce("title", "source_filename", F.lit("")), F.coalesce("section_title", F.lit("")), F.col("physical_page_number").cast("string"), F.col("text")]
    return joined.select("id", F.md5(F.concat_ws("|", *fields)).alias("digest"))


@query("""SELECT CASE WHEN scope.document_id IS NOT NULL THEN 'document' WHEN scope.course_id IS NOT NULL THEN 'course' WHEN scope.subject IS NOT NULL THEN 'subject' ELSE 'all' END AS level, count(*) AS n
    FROM (SELECT DISTINCT ON (id) * FROM conversations) GROUP BY 1""")
def scope_labels(spark, sf_dir):
    """Conversations by the level of their scope; the narrowest part that is set counts."""
    level = F.when(F.col("scope.document_id").isNotNull(), "document").when(F.col("scope.course_id").isNotNull(), "course").when(F.col("scope.subject").isNotNull(), "subject").otherwise("all")
    return library.once(table(spark, sf_dir, "conversations")).groupBy(level.alias("level")).agg(F.count("*").alias("n"))
