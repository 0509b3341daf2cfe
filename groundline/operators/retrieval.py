"""Scoped retrieval by exact cosine: scoring, top-k for one query or many, cutoff and labels, lexical vectors, evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundline.functions.text import terms

#: Numbers of query vectors sent with each task at most (32 MB), more are worked through in slices; queries and rows scored together.
QUERY_CELLS, QUERY_BLOCK, ROW_BLOCK = 4_000_000, 256, 2048
#: Cutoffs of the score for vectors of a model and for lexical vectors.
MODEL_CUTOFF, LEXICAL_CUTOFF = 0.40, 0.10
BUCKETS = 1024
# The French and English function words that lexical vectors leave out.
STOP_WORDS = """
    a an and are as at be by do does for from how in is it of on or that the this to was what
    when where which who why will with can about into its than then there these those
    au aux avec ce ces cet cette dans de des du elle en est et il ils je la le les leur lui
    ma mais me mes mon ne nous on ou par pas pour qu que qui sa se ses son sont sur ta te
    tes ton tu un une vos votre vous comment quel quelle quels quelles quoi est-ce
""".split()


def usable(vector: Column, width: int) -> Column:
    """The vector has the width and only finite values, and is not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == width) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, null where it is not defined, so that it sorts last and never displaces a row."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    score = F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))
    return F.when(~F.isnan(score), score)


def in_scope(rows: DataFrame, subject: str | None = None, course_id: str | None = None, document_id: str | None = None) -> DataFrame:
    """Rows of the scope; each absent part of the scope stands for everything. The filters reach the scan."""
    for column, value in (("subject", subject), ("course_id", course_id), ("document_id", document_id)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows


def top_chunks(scored: DataFrame, k: int, keys: tuple[str, ...] = (), key: str = "chunk_id") -> DataFrame:
    """The k rows of highest score, over all or for each value of keys, ties by id; adds rank from 1. Null scores are dropped."""
    rows = scored.filter(F.col("score").isNotNull())
    if not keys:
        rows = rows.orderBy(F.desc("score"), key).limit(k)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), key))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


class Best:
    """The k best different ids of every query (and scope) among the rows that a task has seen; equal scores by the lesser id."""

    def __init__(self, queries: int, k: int):
        self.queries, self.k = queries, k
        self.group, self.score, self.name = np.zeros(0, np.int64), np.zeros(0), None
        self.scopes: dict = {}

    def add(self, matrix: np.ndarray, rows: np.ndarray, names: np.ndarray, scopes: list | None = None) -> None:
        """Score rows against all queries, a block of each at a time; scopes must be sorted if given."""
        cuts = [0, len(rows)] if scopes is None else [0, *[i for i in range(1, len(scopes)) if scopes[i] != scopes[i - 1]], len(rows)]
        number = [self.scopes.setdefault(None if scopes is None else scopes[a], len(self.scopes)) for a in cuts[:-1]] if len(rows) else []
        group, score, place = [self.group], [self.score], []
        for q in range(0, self.queries, QUERY_BLOCK):
            all_scores = np.round(matrix[q : q + QUERY_BLOCK] @ rows.T, 12)
            for scope, a, b in zip(number, cuts, cuts[1:]):
                part = all_scores[:, a:b]
                keep = part >= np.partition(part, b - a - self.k, axis=1)[:, b - a - self.k, None] if b - a > self.k else np.ones(part.shape, bool)
                r, c = np.nonzero(keep)
                group.append((r + q) + scope * self.queries)
                score.append(part[r, c])
                place.append(c + a)
        new = names[np.concatenate(place)] if place else names[:0]
        name = new if self.name is None else np.concatenate([self.name, new])
        group, score = np.concatenate(group), np.concatenate(score)
        _, code = np.unique(name, return_inverse=True)
        order = np.lexsort((code, -score, group))
        group, score, name, code = group[order], score[order], name[order], code[order]
        fresh = np.append(True, (group[1:] != group[:-1]) | (code[1:] != code[:-1]))[: len(group)]  # copies of a row stand together
        group, score, name = group[fresh], score[fresh], name[fresh]
        first = np.searchsorted(group, group)
        kept = np.arange(len(group)) - first < self.k
        self.group, self.score, self.name = group[kept], score[kept], name[kept]

    def batch(self, ids: list, id_type: pa.DataType, query_type: pa.DataType, key: str, scope: str | None) -> pa.RecordBatch:
        columns = {"query_id": pa.array([ids[g] for g in (self.group % self.queries).tolist()], query_type), key: pa.array(self.name, id_type), "score": pa.array(self.score)}
        if scope:
            back = list(self.scopes)
            columns[scope] = pa.array([back[g] for g in (self.group // self.queries).tolist()], pa.string())
        return pa.RecordBatch.from_pydict(columns)


def search(queries: DataFrame, rows: DataFrame, k: int, width: int, vectors: Callable[[pa.RecordBatch], np.ndarray], key: str, scope: str | None = None) -> DataFrame:
    """(query_id, key, [scope,] score, rank) of the k best rows of every query (in every scope), exactly.

    The queries (query_id, vector) of a slice are sent to the tasks as one matrix of a bounded size; each task keeps its k best for each
    query while it reads, so the shuffle carries k rows for a query (and scope) and task, not all scores. vectors makes unit vectors of a batch.
    """
    spark = rows.sparkSession
    slice_ = max(1, QUERY_CELLS // width)
    few = queries.select("query_id", "vector").limit(slice_ + 1).toArrow()  # one pass where one slice holds them
    number = 1 if few.num_rows <= slice_ else -(-queries.count() // slice_)
    key_type, query_type = rows.schema[key].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    schema = f"query_id {query_type}, {key} {key_type}, score double" + (f", {scope} string" if scope else "")
    out = None
    for part in range(number):
        taken = few if number == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(number)) == part).select("query_id", "vector").toArrow()
        matrix = np.asarray(taken.column("vector").combine_chunks().flatten(), np.float64).reshape(-1, width)
        sent = spark.sparkContext.broadcast((taken.column("query_id").to_pylist(), unit(matrix)))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, matrix = sent.value
            best = Best(len(ids), k)
            for whole in batches:
                for start in range(0, whole.num_rows, ROW_BLOCK):
                    batch = whole.slice(start, ROW_BLOCK)
                    if scope:
                        batch = batch.sort_by(scope)
                    names = batch.column(key).to_numpy(zero_copy_only=False)
                    once = np.sort(np.unique(names, return_index=True)[1])  # a copy would take the place of another row
                    if len(once) < len(names):
                        batch, names = batch.take(pa.array(once)), names[once]
                    best.add(matrix, vectors(batch), names, batch.column(scope).to_pylist() if scope else None)
            if best.name is not None:
                yield best.batch(ids, kinds[key_type], kinds[query_type], key, scope).select([f.split()[0] for f in schema.split(", ")])

        one = rows.mapInArrow(scan, schema)
        out = one if out is None else out.unionByName(one)
    keys = ("query_id", scope) if scope else ("query_id",)
    return top_chunks(out.groupBy(*keys, key).agg(F.max("score").alias("score")), k, keys, key=key)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def batch_top(queries: DataFrame, chunks: DataFrame, k: int, width: int, scope: str | None = None) -> DataFrame:
    """The k best chunks (chunk_id, vector[, scope]) for every query vector, exactly; copies of a chunk count once. All vectors are usable."""
    vectors = lambda batch: unit(np.asarray(batch.column("vector").flatten(), np.float64).reshape(-1, width))
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "vector")
    return search(asked, chunks.select("chunk_id", "vector", *([scope] if scope else [])), k, width, vectors, "chunk_id", scope)


def cutoff_for(provider: Column, given: Column | None = None) -> Column:
    """The cutoff of the vectors of a provider: the one that is given, else that of the local model or of lexical vectors."""
    own = F.when(provider == "local", MODEL_CUTOFF).otherwise(LEXICAL_CUTOFF)
    return own if given is None else F.coalesce(given, own)


def labelled(ranked: DataFrame, cutoff: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """The rows that reach the cutoff, after the limit, with labels from 1 in order of rank."""
    kept = ranked.filter(F.col("score") >= cutoff)
    return kept.withColumn("label", F.row_number().over(Window.partitionBy(*keys).orderBy("rank")))


def bucket_of(term: str) -> tuple[int, float]:
    """(bucket, sign) of a term in the hashing trick: from the first four bytes of its SHA-256, and the last bit of the fifth."""
    digest = sha256(term.encode()).digest()
    return int.from_bytes(digest[:4], "big") % BUCKETS, 1.0 if digest[4] & 1 else -1.0


def _hashing_input(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, terms, own): the terms of every text that is not blank, and the bucket of the text as a whole."""
    kept = texts.filter(F.col(text).rlike(r"[^\s\p{Z}]"))
    own = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % BUCKETS
    return kept.select(key, F.filter(terms(F.col(text)), lambda w: ~w.isin(STOP_WORDS)).alias("terms"), own.cast("int").alias("own"))


def hashed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight) of the unit vectors of a batch (terms, own); each distinct term is hashed once.

    Signed hashing of terms, weighted 1 + ln(count). A text whose terms leave nothing (stop words alone, or terms that cancel each other out)
    has the bucket of the text itself.
    """
    lists = batch.column("terms")
    words = lists.flatten().dictionary_encode()
    places = [bucket_of(w) for w in words.dictionary.to_pylist()]
    bucket, sign = np.array([p for p, _ in places], np.int64), np.array([s for _, s in places])
    row = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
    kinds = max(1, len(places))
    pair, count = np.unique(row * kinds + np.asarray(words.indices, np.int64), return_counts=True)
    term = pair % kinds
    cell, at = np.unique(pair // kinds * BUCKETS + bucket[term], return_inverse=True)
    weight = np.bincount(at, weights=sign[term] * (1 + np.log(count)), minlength=len(cell))
    row = cell // BUCKETS
    norm = np.sqrt(np.bincount(row, weights=weight * weight, minlength=batch.num_rows))
    bare = np.flatnonzero(norm == 0)
    held = weight != 0
    row, bucket, weight = row[held], (cell % BUCKETS)[held], weight[held]
    return np.append(row, bare), np.append(bucket, np.asarray(batch.column("own"))[bare]), np.append(weight / norm[row], np.ones(len(bare)))


def term_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(term, n, docs): occurrences of every term and the texts that hold it. Each batch is counted as it is read, so that one row for each
    of its different terms is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            words = lists.flatten().dictionary_encode()
            kinds, code = len(words.dictionary), np.asarray(words.indices, np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
            held = np.unique(row * max(1, kinds) + code) % max(1, kinds)
            counts = [pa.array(np.bincount(c, minlength=kinds)) for c in (code, held)]
            yield pa.RecordBatch.from_arrays([words.dictionary, *counts], ["term", "n", "docs"])

    listed = texts.filter(F.col(text).isNotNull()).select(terms(F.col(text)).alias("terms"))
    return listed.mapInArrow(run, "term string, n long, docs long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def lexical_vectors(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Sparse unit vectors (key, bucket, weight) of texts, made inside each row: nothing is shuffled. A null or blank text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, bucket, weight = hashed(batch)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row)), pa.array(bucket.astype(np.int32)), pa.array(weight)], [key, "bucket", "weight"])

    return _hashing_input(texts, key, text).mapInArrow(run, f"{key} {texts.schema[key].dataType.simpleString()}, bucket int, weight double")


def lexical_top(queries: DataFrame, docs: DataFrame, k: int, key: str = "doc_id", text: str = "text", digits: int = 9) -> DataFrame:
    """(query_id, key, score, rank) of the k documents whose hashed terms are closest to the text of each query (query_id, text).

    Scores are rounded to digits, so that copies of a text tie and rank by key.
    """

    def dense(batch: pa.RecordBatch) -> np.ndarray:
        row, bucket, weight = hashed(batch)
        out = np.zeros((batch.num_rows, BUCKETS))
        out[row, bucket] = weight
        return out

    vector = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.coalesce(F.element_at("w", b), F.lit(0.0)))
    sparse = lexical_vectors(queries, "query_id").groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("w"))
    found = search(sparse.select("query_id", vector.alias("vector")), _hashing_input(docs, key, text), k, BUCKETS, dense, key)
    return found.withColumn("score", F.round("score", digits))


def rank_report(ranks: DataFrame) -> DataFrame:
    """hit@1, hit@3, hit@8 and the mean reciprocal rank over (rank), counted from 1, null for a miss."""
    hit = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))
    return ranks.agg(F.count("*").alias("questions"), hit(1).alias("hit_1"), hit(3).alias("hit_3"), hit(8).alias("hit_8"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))
