"""Search: inverted index, BM25, exact vector search, rank fusion, and their evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import dot
from ..shared import shared_path

# BM25's constants, that of rank fusion, and the characters from which a token must be known.
K1, B = 1.2, 0.75
RRF_K = 60
UNKNOWN_LENGTH = 4
#: Folders of an index's postings: a search reads those of its terms alone.
TERM_BUCKETS = 32


def latin_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


# Latin terms with their inner signs, the share of Hangul from which a text is Korean, particles that end a word.
LATIN_TERM = r"[a-z0-9]+(?:[+\-][a-z0-9]+)*\+?"
KOREAN_SHARE = 0.05
PARTICLES = ("에서는", "으로는", "에서", "으로", "에게", "까지", "부터", "보다", "처럼", "이랑", "하고", "은", "는", "이", "가", "을", "를", "에", "의", "와", "과", "도", "로", "만", "랑")


def search_tokens(text: Column, aliases: Sequence[str] = ()) -> Column:
    """The terms of a text by its script, in order; none for a null text. The text is to be in compatibility form (``names.nfkc``, as a column of its own).

    A text that is Latin gives its Latin terms (``spf50+`` is one). A Korean one gives the words of two syllables or more
    without their particle (there is no morphology here: a verb keeps its ending), then its Latin terms of two characters or more;
    and after each term the ``aliases`` (Hangul, without blanks, of two characters or more) inside it, in order.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    latin = F.regexp_extract_all(low, F.lit(LATIN_TERM), 0)
    hangul = F.length(F.regexp_replace(low, "[^가-힣]", ""))
    bare = F.transform(F.regexp_extract_all(low, F.lit("[가-힣]+"), 0), lambda w: F.coalesce(F.nullif(F.regexp_extract(w, f"^([가-힣]{{2,}}?)(?:{'|'.join(PARTICLES)})$", 1), F.lit("")), w))
    words = F.concat(F.filter(bare, lambda w: F.length(w) >= 2), F.filter(latin, lambda w: F.length(w) >= 2))
    inner = sorted({a for a in aliases if len(a) >= 2 and " " not in a})
    if inner:
        known = F.array(*map(F.lit, inner))
        words = F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.filter(known, lambda a: (a != w) & w.contains(a)))))
    return F.when(hangul > KOREAN_SHARE * F.length(low), words).otherwise(latin)


def query_tokens(text: Column, stop: Sequence[str], aliases: Sequence[str] = ()) -> Column:
    """The terms of a query without stop words; all of them where nothing else is left, as no term finds nothing."""
    words = F.array(*map(F.lit, stop)).cast("array<string>")
    or_all = lambda found: F.element_at(F.transform(F.array(F.filter(found, lambda w: ~F.array_contains(words, w))), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(found)), 1)
    # through arrays of one, so that the terms are found once
    return F.element_at(F.transform(F.array(search_tokens(text, aliases)), or_all), 1)


def term_counts(tokens: Column) -> Column:
    """The distinct tokens of an array with how often each is there, (term, tf), by term; work grows with the array and its sorting."""

    def runs(s: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == F.size(s)) | (F.element_at(s, i) != F.try_element_at(s, i + 1)))
        counted = lambda e: F.transform(e, lambda x, k: F.struct(F.element_at(s, x).alias("term"), (x - F.when(k > 0, e[k - 1]).otherwise(0)).cast("long").alias("tf")))
        return F.element_at(F.transform(F.array(ends), counted), 1)

    # through arrays of one, so that what an inner function looks at is made once
    some = F.element_at(F.transform(F.array(F.array_sort(tokens)), runs), 1)
    return F.when(F.size(tokens) > 0, some).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))


def postings(docs: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """(term, doc, tf, length): an inverted index; a document's length is its number of tokens. Terms are counted within their row, so nothing is shuffled."""
    t = docs.select(doc, tokens.alias("__t")).select(doc, F.size("__t").alias("length"), F.explode(term_counts(F.col("__t"))).alias("p"))
    return t.select("p.term", doc, "length", "p.tf")


def term_bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


@dataclass(frozen=True)
class StoredIndex:
    """An inverted index in the shared folder: postings by bucket of their term, each term's df, and the corpus sizes.

    The corpus is tokenised once, when it is built; searches read the buckets of their terms.
    """

    spark: SparkSession
    folder: str

    @property
    def postings(self) -> DataFrame:
        """(term, doc, length, tf)."""
        return self.spark.read.parquet(f"{self.folder}/postings")

    @property
    def terms(self) -> DataFrame:
        """(term, df)."""
        return self.spark.read.parquet(f"{self.folder}/terms")

    @property
    def sizes(self) -> DataFrame:
        """One row (n, average): documents and their mean number of tokens."""
        return self.spark.read.parquet(f"{self.folder}/sizes")

    def of(self, terms: DataFrame) -> DataFrame:
        """The postings of a small table of terms, with df; partition pruning leaves out all other buckets."""
        wanted = terms.select("term").distinct().withColumn("bucket", term_bucket(F.col("term")))
        df = F.broadcast(wanted.join(self.terms.select("term", "df", "bucket"), ["bucket", "term"]))
        return self.postings.join(df, ["bucket", "term"]).drop("bucket")


def build_index(docs: DataFrame, doc: str, tokens: Column, folder: str | None = None) -> StoredIndex:
    """Writes the index of ``docs``, to a folder of its own if none is given. A frequent term's postings are in all parts of its bucket."""
    index = StoredIndex(docs.sparkSession, folder or shared_path(docs.sparkSession, "index"))
    found = postings(docs, doc, tokens).withColumn("bucket", term_bucket(F.col("term")))
    # a bucket's files are as many as its share of the tasks, and a hot term is in all of them
    width = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = max(1, width // TERM_BUCKETS)
    dealt = found.repartition(width, "bucket", F.pmod(F.xxhash64(doc), F.lit(parts)))
    dealt.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{index.folder}/postings")
    stored = index.postings
    stored.groupBy("bucket", "term").agg(F.count("*").alias("df")).sortWithinPartitions("bucket", "term").write.parquet(f"{index.folder}/terms")
    # documents without tokens count as well
    lengths = stored.agg(F.sum("tf").alias("total")).crossJoin(docs.agg(F.count("*").alias("n")))
    lengths.select("n", (F.coalesce("total", F.lit(0)) / F.col("n")).alias("average")).write.parquet(f"{index.folder}/sizes")
    return index


def bm25(index: StoredIndex, queries: DataFrame, doc: str, k: int | None = 10) -> DataFrame:
    """(query, doc, score, place) for ``queries`` (query, term), a small table: Robertson-Sparck Jones weights, not below 0; ties by doc."""
    terms = queries.select("query", "term").distinct()
    hits = index.of(terms).join(F.broadcast(terms), "term").crossJoin(F.broadcast(index.sizes))
    idf = F.greatest(F.lit(0.0), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average"))
    scored = hits.groupBy("query", doc).agg(F.round(F.sum(idf * F.col("tf") * (K1 + 1) / norm), 4).alias("score")).where("score > 0")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), doc))
    ranked = scored.withColumn("place", place)
    return ranked if k is None else ranked.where(F.col("place") <= k)


def vector_search(store: DataFrame, key: str, vector: str, queries: DataFrame, query: str, query_vector: str, k: int, mask: Column | None = None) -> DataFrame:
    """(query, key, similarity, place): exact dot products of unit vectors, of the rows that a ``mask`` lets through; NaN goes; ties by key.

    ``queries`` is a stated set, collected and broadcast (eight bytes a place), so this starts a job. Tasks multiply blocks of both sides as
    matrices and keep each query's best k: of rows that rounding could bring among them the product is summed anew, place by place,
    so values and ties are those of ``dot``. Vectors that are null, of another length or infinite go by rows.
    """
    spark = store.sparkSession
    s = (store if mask is None else store.where(mask)).select(key, vector)
    q = queries.select(F.col(query).alias("query"), F.col(query_vector).alias("__q"))
    sizes = [r[0] for r in q.where(_plain("__q")).groupBy(F.size("__q").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()]
    size = sizes[0] if sizes else 0
    regular = lambda c: _plain(c) & (F.size(c) == size)
    asked = q.where(regular("__q")).select("query", F.col("__q").cast("array<double>")).toArrow().combine_chunks()

    def by_rows(rows: DataFrame, of: DataFrame) -> DataFrame:
        pairs = rows.crossJoin(F.broadcast(of))
        return pairs.select("query", key, dot(F.col(vector), F.col("__q")).alias("similarity")).where(~F.isnan("similarity"))

    found = by_rows(s, q.where(~regular("__q")))
    if asked.num_rows and size:
        width = int(spark.conf.get("spark.sql.shuffle.partitions"))
        schema = T.StructType([q.schema["query"], s.schema[key], T.StructField("similarity", T.DoubleType())])
        shared = spark.sparkContext.broadcast((asked.column(0).combine_chunks(), asked.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)))
        # with a NaN among numbers every product is NaN, and goes
        lost = F.coalesce((F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull()) & F.exists(vector, lambda x: F.isnan(x)), F.lit(False))
        rows = s.where(regular(vector)).select(key, F.col(vector).cast("array<double>")).repartition(width)
        best = rows.mapInArrow(lambda batches: _best_of(batches, shared.value, k, key), schema)
        found = found.unionByName(best).unionByName(by_rows(s.where(~regular(vector) & ~lost), q.where(regular("__q"))))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("similarity").desc(), key))
    return found.withColumn("place", place).where(F.col("place") <= k)


#: Rows and queries that are multiplied at a time; the greatest entry of a vector whose products are finite.
BLOCK_ROWS, BLOCK_QUERIES = 2048, 1024
GREATEST = 1e100


def _plain(vector: str) -> Column:
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) <= GREATEST)), F.lit(False))


def _best_of(batches, asked, k: int, key: str):
    """Of a task's rows the k best of each query, ties by key."""
    ids, q = asked
    found: dict[int, pa.Table] = {}
    least = np.full(len(q), -np.inf)  # what a row has to reach, by query
    norms = np.linalg.norm(q, axis=1)
    for batch in batches:
        rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        for i in range(0, len(rows), BLOCK_ROWS):
            x, keys = rows[i : i + BLOCK_ROWS], batch.column(0).slice(i, BLOCK_ROWS)
            # sums in another order differ by at most so much, relative to both norms
            error = 4 * x.shape[1] * np.finfo(float).eps * np.linalg.norm(x, axis=1).max()
            for b in range(0, len(q), BLOCK_QUERIES):
                some = slice(b, b + BLOCK_QUERIES)
                near = q[some] @ x.T
                if b not in found and len(x) > k:
                    least[some] = np.partition(near, -k, axis=1)[:, -k] - error * norms[some]
                at, row = np.nonzero(near >= (least[some] - error * norms[some])[:, None])
                exact = np.zeros(len(at))
                for d in range(x.shape[1]):
                    exact += x[row, d] * q[b + at, d]
                t = pa.table({"q": pa.array(at), "similarity": pa.array(exact), "key": keys.take(pa.array(row))})
                t = pa.concat_tables([found[b], t]) if b in found else t
                t = t.take(pc.sort_indices(t, [("q", "ascending"), ("similarity", "descending"), ("key", "ascending")], null_placement="at_start"))
                of = t.column("q").to_numpy()
                rank = np.arange(len(of)) - np.searchsorted(of, of)
                last = rank == k - 1
                least[b + of[last]] = t.column("similarity").to_numpy()[last]
                found[b] = t.filter(pa.array(rank < k))
    for b, t in found.items():
        columns = [ids.take(pa.array(t.column("q").to_numpy() + b)), t.column("key").combine_chunks(), t.column("similarity").combine_chunks()]
        yield pa.RecordBatch.from_arrays(columns, names=["query", key, "similarity"])


def fuse(rankings: Sequence[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of rankings (query, key, place); ties by the best first ranking's place, then key."""
    parts = [r.select("query", key, "place", F.lit(i).alias("__i")) for i, r in enumerate(rankings)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    g = every.groupBy("query", key).agg(F.sum(1.0 / (k + F.col("place"))).alias("score"), F.min_by("place", "__i").alias("first"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "first", key)))


def grounding(queries: DataFrame, index: StoredIndex) -> DataFrame:
    """(query, ok, missing): a token of UNKNOWN_LENGTH characters or more that no document has blocks the query."""
    asked = queries.select("query", "term").withColumn("bucket", term_bucket(F.col("term")))
    known = index.terms.join(F.broadcast(asked.select("bucket", "term").distinct()), ["bucket", "term"]).select("term", F.lit(True).alias("__known"))
    q = asked.join(F.broadcast(known), "term", "left")
    missing = F.array_sort(F.collect_set(F.when(F.col("__known").isNull() & (F.length("term") >= UNKNOWN_LENGTH), F.col("term"))))
    return q.groupBy("query").agg(missing.alias("missing")).withColumn("ok", F.size("missing") == 0)


def search(engine: str, index: StoredIndex | None, store: DataFrame | None, queries: DataFrame, vectors: DataFrame | None, doc: str, k: int = 10, fetch: int = 4, vector: str = "embedding") -> DataFrame:
    """(query, doc, place) by an engine: ``bm25``, ``vector`` or ``hybrid`` (both, ``fetch`` times as deep, fused).

    ``queries`` are (query, term), ``vectors`` (query, vector). Where there is an index, a query that the grounding
    gate blocks is in no result, and its vector meets no row of the store.
    """
    if engine not in ("bm25", "vector", "hybrid"):
        raise ValueError(f"no engine {engine!r}")
    if index is None and engine != "vector" or store is None and engine != "bm25":
        raise ValueError(f"engine {engine!r} needs its index or store")
    if index is not None:
        open_ = F.broadcast(grounding(queries, index).where("ok").select("query"))
        queries = queries.join(open_, "query", "left_semi")
        vectors = vectors.join(open_, "query", "left_semi") if vectors is not None else None
    deep = k * fetch if engine == "hybrid" else k
    words = bm25(index, queries, doc, deep) if engine != "vector" else None
    near = vector_search(store, doc, vector, vectors, "query", "vector", deep) if engine != "bm25" else None
    ranked = words if engine == "bm25" else near if engine == "vector" else fuse([words, near], doc)
    return ranked.where(F.col("place") <= k).select("query", doc, "place")


def alias_queries(aliases: DataFrame, topic: str, alias: str, tokens) -> DataFrame:
    """(query, topic, term) of a dictionary: each distinct alias is a query of its topic's, by its tokens; one without tokens gives none."""
    a = aliases.select(F.col(topic).alias("topic"), F.trim(alias).alias("query")).where("query != ''").distinct()
    return a.select("query", "topic", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))


def held_out(gold: DataFrame, index: StoredIndex, queries: DataFrame, doc: str) -> DataFrame:
    """``gold`` (query, doc) without the documents that have any token of their query, so that words alone can't find them."""
    with_token = index.of(queries).join(F.broadcast(queries.select("query", "term").distinct()), "term").select("query", doc)
    return gold.join(with_token, ["query", doc], "left_anti")


def evaluated(ranked: DataFrame, gold: DataFrame, key: str, k: int) -> DataFrame:
    """(query, precision, reciprocal, hit) of rankings (query, key, place) against ``gold`` (query, key)."""
    hits = ranked.where(F.col("place") <= k).join(gold.select("query", key).withColumn("__g", F.lit(1)), ["query", key], "left")
    own = hits.groupBy("query").agg((F.count("__g") / F.lit(k)).alias("precision"), F.min(F.when(F.col("__g") == 1, F.col("place"))).alias("__f"))
    out = gold.select("query").distinct().join(own, "query", "left")
    return out.select("query", F.coalesce("precision", F.lit(0.0)).alias("precision"), F.coalesce(1.0 / F.col("__f"), F.lit(0.0)).alias("reciprocal"), F.col("__f").isNotNull().alias("hit"))


def folded(ranked: DataFrame, doc: str, piece: str, k: int) -> DataFrame:
    """Ranked pieces folded to their documents, by best place; the pieces' texts joined in rank order."""
    g = ranked.groupBy("query", doc).agg(F.min("place").alias("best"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", piece))), lambda s: s[piece]), " … ").alias("evidence"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("best", doc))).where(F.col("place") <= k)
