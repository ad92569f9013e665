"""A stored lexical index: built once, searched many times, changed by what is added and removed.

An index is a folder of Parquet tables.

``postings``  (version, token, block, record_id, tf, dl), bucketed by (token, block): a search shuffles its own
              small rows to the buckets and never the postings, and a common token is spread over its blocks.
              Rows of a token and block lie together; one number orders them, so that no text is compared.
``blocks``    (version, token, block, max_tf, min_dl): the most that a token can add to a score inside a block.
``terms``     (version, token, df, max_tf, min_dl): document frequencies as differences, negative for what went.
``records``   (version, record_id, block, dl), ``removed`` (version, record_id), and ``commits``
              (version, kind, n, dl), the last table that a change writes.

A block holds about ``BLOCK`` records of similar length, so the bounds are tight. Rows of a version without a
commit are not read, so a change that failed half way is not seen and may be run again; there is one writer
at a time. A removed record stays in the postings, its id and version mask it, and its tokens are subtracted
from the frequencies: scores are those of an index built anew. ``compacted`` builds one without the dead rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from ..functions.staging import staged
from ..session import cut_lineage
from .retrieval import cosine

BLOCK = 64
_MATCH = "rank int, score double, semantic_score double, lexical_score double, lexical_coverage double, match_mode string"
_CHANGE = "version long, kind string, n long, dl long"
_SCHEMAS = {"blocks": "token string, block long, max_tf long, min_dl long", "terms": "token string, df long, max_tf long, min_dl long",
            "records": "record_id {id}, block long, dl long", "removed": "record_id {id}"}


@dataclass(frozen=True)
class Snapshot:
    """The committed versions of an index, its records and their tokens, and the kinds of its changes."""

    index: SearchIndex
    versions: list[int]
    n: int
    tokens: int
    kinds: set[str]

    def table(self, name: str) -> DataFrame:
        """The committed rows of one of the tables."""
        return self.index._raw(name).where(F.col("version").isin(self.versions))

    @property
    def average(self) -> float:
        """Mean number of tokens of a record, one at least."""
        return max(1.0, self.tokens / self.n) if self.n else 1.0

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows (version, record_id, ...) that no later removal masks."""
        if "remove" not in self.kinds:
            return rows
        gone = self.table("removed").groupBy("record_id").agg(F.max("version").alias("_gone"))
        return rows.join(gone, "record_id", "left").where("_gone is null or _gone <= version").drop("_gone")


@dataclass(frozen=True)
class SearchIndex:
    """An open index: where it is, the name of its postings table in this session, and what is committed."""

    spark: SparkSession
    folder: str
    postings_name: str
    id_type: str
    buckets: int

    def snapshot(self) -> Snapshot:
        """What is committed now; the commits are read once."""
        rows = self.commits().collect()
        return Snapshot(self, [r.version for r in rows], sum(r.n for r in rows), sum(r.dl for r in rows), {r.kind for r in rows})

    def _raw(self, name: str) -> DataFrame:
        if name == "postings":
            return self.spark.table(self.postings_name)
        return self.spark.read.schema(_SCHEMAS[name].format(id=self.id_type) + ", version long").parquet(f"{self.folder}/{name}")

    def commits(self) -> DataFrame:
        """One row for each change; their number is bounded by compaction."""
        return self.spark.read.schema(_CHANGE).parquet(f"{self.folder}/commits")

    def next_version(self) -> int:
        """Above every version that any earlier attempt may have written."""
        seen = [self._raw(t).agg(F.max("version")).first()[0] for t in ("records", "removed")]
        return max([v for v in seen if v is not None], default=-1) + 1

    def write(self, df: DataFrame, name: str, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/version={version}")

    def commit(self, version: int, kind: str, totals: DataFrame) -> None:
        totals.select(F.lit(version).cast("long").alias("version"), F.lit(kind).alias("kind"), "n", "dl").coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")


def create_index(spark: SparkSession, folder: str, id_type: str = "long", buckets: int | None = None) -> SearchIndex:
    """An empty index in ``folder``, which all executors must share."""
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.createDataFrame([(id_type, buckets)], "id_type string, buckets int").coalesce(1).write.parquet(f"{folder}/settings")
    index = open_index(spark, folder)
    for name in ("records", "removed"):
        index.write(spark.createDataFrame([], _SCHEMAS[name].format(id=id_type)), name, -1)
    spark.createDataFrame([], _CHANGE).write.parquet(f"{folder}/commits")
    return index


def open_index(spark: SparkSession, folder: str) -> SearchIndex:
    """An index that ``create_index`` made, in this session or another."""
    id_type, buckets = spark.read.parquet(f"{folder}/settings").first()
    name = f"postings_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (version BIGINT, token STRING, block BIGINT, record_id {id_type}, tf BIGINT, dl BIGINT) USING parquet "
              f"CLUSTERED BY (token, block) INTO {buckets} BUCKETS LOCATION '{folder}/postings'")
    return SearchIndex(spark, folder, name, id_type, buckets)


def add_records(index: SearchIndex, records: DataFrame) -> None:
    """Index ``records`` (record_id, text); a record whose id the index has is replaced.

    Of rows that repeat an id one is taken, the one with the greatest text; rows without an id are left
    out. Texts without tokens count in the statistics.
    """
    rows = records.where("record_id is not null").groupBy("record_id").agg(F.max("text").alias("text"))
    # texts are cut into tokens once; everything else reads the result
    tokens = cut_lineage(rows.select("record_id", T.retrieval_tokens(F.col("text")).alias("tokens")).select(
        "record_id", "tokens", F.size("tokens").cast("long").alias("dl")))
    if index.snapshot().kinds:
        remove_records(index, tokens.select("record_id"))
    version = index.next_version()
    # records of similar length share blocks; there are at most 64 classes of length
    length = F.floor(F.log2(F.col("dl") + 1)).cast("long")
    counts = {r[0]: -(-r[1] // BLOCK) for r in tokens.groupBy(length.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = F.create_map(*(F.lit(x) for pair in counts.items() for x in pair)) if counts else F.create_map().cast("map<long,int>")
    block = (F.lit(version) * (1 << 40) + length * (1 << 34) + F.pmod(F.xxhash64("record_id"), F.element_at(blocks, length))).cast("long")
    tokens = tokens.withColumn("block", block)
    index.write(tokens.select("record_id", "block", "dl"), "records", version)
    # one shuffle to the buckets; the counts are made where the rows are written
    terms = tokens.select("record_id", "block", "dl", F.explode("tokens").alias("token")).repartition(index.buckets, "token", "block").groupBy(
        "token", "block", "record_id", "dl").agg(F.count(F.lit(1)).alias("tf")).sortWithinPartitions(_together())
    # behind a generator the order is kept; the writer's own order begins with the bucket, which is the same for a whole task
    postings = staged(terms, version=F.lit(version).cast("long")).select("version", "token", "block", "record_id", "tf", "dl")
    (postings.write.format("parquet").mode("append").bucketBy(index.buckets, "token", "block")
     .option("path", f"{index.folder}/postings").saveAsTable(index.postings_name))
    stored = index._raw("postings").where(F.col("version") == version)
    index.write(stored.groupBy("token", "block").agg(F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.count(F.lit(1)).alias("n"))
                .sortWithinPartitions(_together()), "blocks", version)
    per_block = index.spark.read.parquet(f"{index.folder}/blocks/version={version}")
    index.write(per_block.groupBy("token").agg(F.sum("n").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl")), "terms", version)
    index.commit(version, "add", tokens.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")))


def _together() -> Column:
    """One number that orders rows by the hash of their token and then of their block."""
    return F.hash("token").cast("long") * (1 << 32) + F.hash("block")


def remove_records(index: SearchIndex, ids: DataFrame) -> None:
    """Take the records of ``ids`` (record_id) out; ids that the index does not have are ignored."""
    now = index.snapshot()
    gone = now.live(now.table("records")).join(ids.select("record_id").distinct(), "record_id", "left_semi")
    gone = cut_lineage(gone.select("record_id", "block", "dl", F.col("version").alias("_of")))
    if gone.isEmpty():
        return
    version = index.next_version()
    index.write(gone.select("record_id"), "removed", version)
    held = now.table("postings").join(gone.select("record_id", F.col("_of").alias("version")), ["record_id", "version"], "left_semi")
    index.write(held.groupBy("token").agg((-F.count(F.lit(1))).alias("df"), F.lit(None).cast("long").alias("max_tf"), F.lit(None).cast("long").alias("min_dl")), "terms", version)
    index.commit(version, "remove", gone.agg((-F.count(F.lit(1))).alias("n"), (-F.sum("dl")).alias("dl")))


def _gain(weight: Column, tf: Column, dl: Column, average: float) -> Column:
    length = X.BM25_K1 * ((1 - X.BM25_B) + X.BM25_B * dl / average)
    return weight * tf * (X.BM25_K1 + 1) / (tf + length)


def _lexical(raw: Column) -> Column:
    return F.when(raw > 0, raw / (raw + 2.0)).otherwise(0.0)


def _required(n_terms: Column) -> Column:
    return F.when(n_terms <= 2, 1).otherwise(2)


def _weights(now: Snapshot, queries: DataFrame) -> DataFrame:
    """(query_id, token, weight, prefix, share, tail, n_terms) of the query tokens that the index has.

    A match holds ``need`` of the n distinct tokens of its query, so of the n - need + share rarest ones at
    least ``share``: those are the prefix. ``tail`` bounds what all tokens after the prefix add together.
    """
    q = queries.select("query_id", T.retrieval_tokens(F.col("query")).alias("q")).where(F.size("q") > 0)
    q = q.select("query_id", "q", F.size(F.array_distinct("q")).alias("n_terms")).select("query_id", "n_terms", F.explode("q").alias("token"))
    q = q.groupBy("query_id", "n_terms", "token").agg(F.count(F.lit(1)).alias("qtf"))
    df = now.table("terms").join(q.select("token").distinct(), "token", "left_semi").groupBy("token").agg(
        F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl")).where("df > 0")
    # tokens that no record has can not be shared, but count in the prefix
    d = q.join(df, "token", "left")
    order = Window.partitionBy("query_id").orderBy(F.coalesce("df", F.lit(0)), "token")
    need = F.greatest(F.ceil(F.col("n_terms") * X.MIN_COVERAGE), _required(F.col("n_terms")))
    share = F.greatest(F.lit(1), F.ceil(need / 2))
    d = d.withColumn("share", share).withColumn("prefix", F.row_number().over(order) <= F.col("n_terms") - need + share).where("df is not null")
    d = d.withColumn("weight", F.col("qtf") * F.log(1 + (now.n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    most = F.when(~F.col("prefix"), _gain(F.col("weight"), F.col("max_tf"), F.col("min_dl"), now.average))
    tail = F.coalesce(F.sum(most).over(Window.partitionBy("query_id")), F.lit(0.0))
    return d.withColumn("tail", tail).select("query_id", "token", "weight", "prefix", "share", "tail", "n_terms")


def candidate_blocks(now: Snapshot, weights: DataFrame) -> DataFrame:
    """(query_id, block, bound): blocks that may hold a match, and the most a score there can be."""
    seen = weights.where("prefix").join(now.table("blocks"), "token")
    d = seen.groupBy("query_id", "block", "share", "tail").agg(
        F.sum(_gain(F.col("weight"), F.col("max_tf"), F.col("min_dl"), now.average)).alias("most"), F.count(F.lit(1)).alias("held"))
    bound = _lexical(F.col("most") + F.col("tail"))
    return d.where((F.col("held") >= F.col("share")) & (bound >= X.MIN_LEXICAL - 1e-9)).select("query_id", "block", bound.alias("bound"))


def _held(now: Snapshot, asked: DataFrame) -> DataFrame:
    """The postings of (token, block) of ``asked``. What is asked goes to the buckets and into a hash table there,
    so the postings are streamed past it: neither shuffled nor sorted."""
    return asked.hint("shuffle_hash").join(now.table("postings"), ["token", "block"])


def shortlist(now: Snapshot, weights: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_id, block, ids): the records of ``blocks`` (query_id, block) that hold enough of the prefix to be a match."""
    held = _held(now, blocks.select("query_id", "block").join(weights.where("prefix"), "query_id"))
    d = held.groupBy("query_id", "block", "record_id", "version", "share", "tail").agg(
        F.sum(_gain(F.col("weight"), F.col("tf"), F.col("dl"), now.average)).alias("most"), F.count(F.lit(1)).alias("held"))
    d = d.where((F.col("held") >= F.col("share")) & (_lexical(F.col("most") + F.col("tail")) >= X.MIN_LEXICAL - 1e-9))
    # as many ids as a block has records at most
    return d.groupBy("query_id", "block").agg(F.collect_set("record_id").alias("ids"))


def scores(now: Snapshot, weights: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, record_id, n_terms, lexical, coverage, matched) of the records ``wanted`` (query_id, block, ids)
    that hold a token of the query."""
    held = _held(now, wanted.join(weights, "query_id")).where(F.array_contains("ids", F.col("record_id")))
    d = held.groupBy("query_id", "record_id", "version", "n_terms").agg(
        F.sum(_gain(F.col("weight"), F.col("tf"), F.col("dl"), now.average)).alias("raw"), F.count(F.lit(1)).alias("matched"))
    return now.live(d).select("query_id", "record_id", "n_terms", _lexical(F.col("raw")).alias("lexical"),
                                  (F.col("matched") / F.col("n_terms")).alias("coverage"), "matched")


def _passes(d: DataFrame) -> Column:
    return ((F.col("lexical") >= X.MIN_LEXICAL) & (F.col("coverage") >= X.MIN_COVERAGE) & (F.col("matched") >= _required(F.col("n_terms"))))


def _top(d: DataFrame, limit: int) -> DataFrame:
    # equal texts must tie: sums of the same terms may differ in the last digits
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "record_id")
    return d.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def lexical_search(index: SearchIndex, queries: DataFrame, limit: int = 10) -> DataFrame:
    """R1, R3 without vectors: the best matches of each query, as ``retrieval.scored_matches`` gives them.

    The blocks of highest bound are scored first; the ``limit``-th best match there is a threshold, and of
    the other blocks only those whose bound reaches it are read.
    """
    now = index.snapshot()
    if not now.kinds:
        return index.spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, record_id {index.id_type}, {_MATCH}")
    weights = cut_lineage(_weights(now, queries))
    blocks = cut_lineage(candidate_blocks(now, weights))
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    turn = blocks.withColumn("_turn", F.row_number().over(order))

    def matches(some: DataFrame) -> DataFrame:
        d = scores(now, weights, shortlist(now, weights, some))
        return d.where(_passes(d)).withColumn("score", X.LEXICAL_WEIGHT * F.col("lexical"))

    first = cut_lineage(_top(matches(turn.where(F.col("_turn") <= limit)), limit))
    floor = first.where(F.col("rank") == limit).select("query_id", F.col("score").alias("floor"))
    rest = turn.where(F.col("_turn") > limit).join(floor, "query_id", "left").where(
        F.col("floor").isNull() | (X.LEXICAL_WEIGHT * F.col("bound") >= F.col("floor") - 1e-8))
    found = first.drop("rank").unionByName(matches(rest))
    return _top(found, limit).select(
        "query_id", "record_id", "rank", "score", F.lit(None).cast("double").alias("semantic_score"), F.col("lexical").alias("lexical_score"),
        F.col("coverage").alias("lexical_coverage"), F.lit("lexical_exact").alias("match_mode"))


def hybrid_search(index: SearchIndex, queries: DataFrame, vectors: DataFrame, semantic: DataFrame, limit: int = 10) -> DataFrame:
    """The best matches of each query by words and vectors.

    ``queries``: query_id, query, q_vec. ``vectors``: record_id, r_vec. ``semantic``: query_id, record_id,
    the pairs that reach the similarity floor (``retrieval.similar_pairs``).
    """
    now = index.snapshot()
    if not now.kinds:
        return index.spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, record_id {index.id_type}, {_MATCH}")
    weights = cut_lineage(_weights(now, queries))
    places = now.live(now.table("records")).select("record_id", "block")
    near = semantic.select("query_id", "record_id").join(places, "record_id")
    listed = shortlist(now, weights, candidate_blocks(now, weights)).unionByName(
        near.groupBy("query_id", "block").agg(F.collect_set("record_id").alias("ids")))
    words = scores(now, weights, listed.groupBy("query_id", "block").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids")))
    both = words.join(near.select("query_id", "record_id", F.lit(True).alias("near")), ["query_id", "record_id"], "full")
    d = both.drop("n_terms").join(queries.select("query_id", "q_vec", F.size(F.array_distinct(T.retrieval_tokens(F.col("query")))).alias("n_terms")), "query_id")
    d = d.where("n_terms > 0").fillna({"lexical": 0.0, "coverage": 0.0, "matched": 0})
    d = d.where(F.coalesce("near", F.lit(False)) | _passes(d)).join(vectors.select("record_id", "r_vec"), "record_id", "left")
    d = d.withColumn("semantic", cosine(F.col("q_vec"), F.col("r_vec")))
    d = d.withColumn("score", X.LEXICAL_WEIGHT * F.col("lexical") + F.coalesce(X.SEMANTIC_WEIGHT * F.greatest(F.lit(0.0), F.col("semantic")), F.lit(0.0)))
    by_vector = F.coalesce((F.col("semantic") >= X.MIN_SEMANTIC) & (F.col("score") >= X.MIN_HYBRID), F.lit(False))
    d = d.where(by_vector | _passes(d)).withColumn("mode", F.when(by_vector, "hybrid").otherwise("lexical_exact"))
    return _top(d, limit).select("query_id", "record_id", "rank", "score", F.col("semantic").alias("semantic_score"), F.col("lexical").alias("lexical_score"),
                                 F.col("coverage").alias("lexical_coverage"), F.col("mode").alias("match_mode"))
