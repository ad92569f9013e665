"""Hybrid retrieval over tables of queries and records."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from ..functions.lists import strip
from ..functions.staging import staged
from ..session import cut_lineage
from .overlap import candidate_pairs

def cosine(a: Column, b: Column) -> Column:
    """R2: cosine clamped to [-1, 1]; null for missing, empty, zero or unequal vectors."""
    num = lambda v: F.transform(v, lambda x: x.cast("double"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(num(a), num(b), lambda x, y: x * y))
    norm = lambda v: F.sqrt(total(F.transform(num(v), lambda x: x * x)))
    score = dot / F.nullif(norm(a) * norm(b), F.lit(0.0))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)),
                  F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)))


def _unit_rows(vectors) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    n[n == 0] = np.inf
    return m / n


#: The most vectors that the space is divided by, and vectors in a block.
PIVOTS, BLOCK = 256, 1024
#: The least and the most tiles of a side (so often is a vector sent), and blocks in a tile where neither binds.
TILES, TILE_BLOCKS = (8, 32), 16


def _pivots(vectors: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Up to ``count`` unit vectors for each length of vector, far from each other.

    They come from a sample of four times as many rows; the choice is bounded and only decides the blocks.
    """
    turn = Window.partitionBy("dim").orderBy(F.xxhash64("vec"))
    rows = vectors.dropDuplicates(["dim", "vec"]).withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= 4 * count).select("dim", "vec").collect()
    return {dim: _far_apart(_unit_rows([r.vec for r in rows if r.dim == dim]), count) for dim in {r.dim for r in rows}}


def _far_apart(unit: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first choice: each next row is the one least similar to all rows chosen."""
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < min(count, len(unit)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return unit[chosen]


def vector_blocks(vectors: DataFrame, pivots: dict[int, np.ndarray], size: int = BLOCK) -> DataFrame:
    """(id, unit, dim, pivot, chunk) from (id, vec): unit vectors with their nearest pivot and a slice of about ``size``.

    Null, empty and zero vectors, and those with a component that is null or not finite, have no cosine and
    are left out.
    """
    kind = vectors.schema["id"].dataType.simpleString()

    def assign(batches):
        for d in batches:
            for dim, part in d.groupby("dim"):
                unit = _unit_rows(part["vec"])
                ok = (unit != 0).any(1)
                if not ok.any():
                    continue
                near = (unit @ pivots[dim].T).argmax(1) if dim in pivots else np.full(len(part), -1)
                yield pd.DataFrame({"id": part["id"].to_numpy()[ok], "unit": list(unit[ok]), "dim": part["dim"].to_numpy()[ok], "pivot": near[ok].astype("int32")})

    placed = _clean(vectors).mapInPandas(assign, f"id {kind}, unit array<double>, dim int, pivot int")
    placed = cut_lineage(placed)
    chunks = placed.groupBy("dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / size).alias("_chunks"))
    return placed.join(chunks, ["dim", "pivot"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("_chunks")).cast("int")).drop("_chunks")


def _clean(vectors: DataFrame) -> DataFrame:
    vec = F.col("vec").cast("array<double>")
    whole = (F.size(vec) > 0) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.coalesce(whole, F.lit(False))).select("id", vec.alias("vec"), F.size("vec").alias("dim"))


def _reach(floor: float) -> float:
    """The largest angle of two vectors with cosine >= floor, and a hair."""
    return float(np.arccos(np.clip(floor, -1, 1))) + 1e-6


def _cone(unit: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit centre of unit vectors and the largest angle to it."""
    centre = unit.mean(0)
    centre = centre / (np.linalg.norm(centre) or 1.0)
    return centre, float(np.arccos(np.clip(unit @ centre, -1, 1)).max())


def block_cones(blocks: DataFrame) -> DataFrame:
    """(dim, pivot, chunk, centre, radius): the cone (unit centre and largest angle to it) that holds a block."""
    def cone(d: pd.DataFrame) -> pd.DataFrame:
        unit = np.stack(d["unit"].to_list())
        centre, radius = _cone(unit)
        return pd.DataFrame({"dim": d["dim"].iloc[:1], "pivot": d["pivot"].iloc[:1], "chunk": d["chunk"].iloc[:1], "centre": [list(centre)], "radius": [radius]})

    return blocks.groupBy("dim", "pivot", "chunk").applyInPandas(cone, "dim int, pivot int, chunk int, centre array<double>, radius double")


def block_pairs(queries: DataFrame, records: DataFrame, pivots: dict[int, np.ndarray], floor: float) -> DataFrame:
    """(dim, q_pivot, q_chunk, pivot, chunk): the pairs of blocks that may hold vectors with cosine >= floor.

    Two cones whose centres are further apart than both radii and the floor's angle hold no such pair. Query
    cones meet the cones of whole pivots first, so that only blocks of pivots within reach are joined.
    """
    reach = _reach(floor)
    far = {(r.dim, r.pivot): r.far for r in records.groupBy("dim", "pivot").agg(F.max(_angle_to(pivots)).alias("far")).collect()}

    def meet(batches):
        for d in batches:
            out = []
            for r in d.itertuples():
                known = [p for (dim, p) in far if dim == r.dim]
                for p in known:
                    apart = np.arccos(np.clip(float(np.dot(r.centre, pivots[r.dim][p])), -1, 1)) if p >= 0 else 0.0
                    if apart - r.radius - far[r.dim, p] <= reach:
                        out.append((r.dim, r.pivot, r.chunk, r.centre, r.radius, p))
            if out:
                yield pd.DataFrame(out, columns=["dim", "q_pivot", "q_chunk", "q_centre", "q_radius", "pivot"])

    near = block_cones(queries).mapInPandas(meet, "dim int, q_pivot int, q_chunk int, q_centre array<double>, q_radius double, pivot int")
    dot = F.aggregate(F.zip_with("q_centre", "centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))
    return near.join(block_cones(records), ["dim", "pivot"]).where(apart - F.col("q_radius") - F.col("radius") <= reach).select(
        "dim", "q_pivot", "q_chunk", "pivot", "chunk")


def _angle_to(pivots: dict[int, np.ndarray]) -> Column:
    """Angle between a unit vector and its pivot; a half turn where there is no pivot."""
    @F.pandas_udf("double")
    def angle(unit: pd.Series, dim: pd.Series, pivot: pd.Series) -> pd.Series:
        return pd.Series([float(np.arccos(np.clip(np.dot(u, pivots[d][p]), -1, 1))) if p >= 0 else np.pi for u, d, p in zip(unit, dim, pivot, strict=True)])
    return angle("unit", "dim", "pivot")


def similar_pairs(queries: DataFrame, records: DataFrame, floor: float, pivots: int | None = None, size: int = BLOCK) -> DataFrame:
    """R2: (query_id, record_id, semantic) of the pairs with cosine >= floor.

    ``queries``: query_id, q_vec. ``records``: record_id, r_vec. Both are cut into blocks around common
    pivots (by default as many as the records fill blocks, at most ``PIVOTS``); only pairs of blocks that can
    reach the floor are multiplied, those of two tiles in one task, and only passing pairs leave it.
    """
    clean = _clean(records.select(F.col("record_id").alias("id"), F.col("r_vec").alias("vec")))
    chosen = _pivots(clean, pivots or min(PIVOTS, -(-clean.count() // size) or 1))
    q = cut_lineage(vector_blocks(queries.select(F.col("query_id").alias("id"), F.col("q_vec").alias("vec")), chosen, size))
    r = cut_lineage(vector_blocks(records.select(F.col("record_id").alias("id"), F.col("r_vec").alias("vec")), chosen, size))
    pairs = cut_lineage(block_pairs(q, r, chosen, floor))
    # blocks travel in tiles: a vector goes once to each tile of the other side that it may meet, not to each block
    number = lambda cols, n: F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
    counts = [d.count() for d in (q, r)]
    tiles = [max(1, min(TILES[1], max(-(-n // (TILE_BLOCKS * size)), min(TILES[0], -(-n // size))))) for n in counts]
    pairs = pairs.withColumn("q_tile", number(["q_pivot", "q_chunk"], tiles[0])).withColumn("tile", number(["pivot", "chunk"], tiles[1]))
    keys = ["dim", "q_tile", "tile"]
    tasks = min(tiles[0] * tiles[1], 1024)
    meets = lambda *side: pairs.select(*(F.col(c).alias(c) for c in (*side, *keys))).distinct()
    left = q.withColumnsRenamed({"pivot": "q_pivot", "chunk": "q_chunk"}).join(
        meets("q_pivot", "q_chunk"), ["dim", "q_pivot", "q_chunk"]).repartition(tasks, *keys)
    right = r.join(meets("pivot", "chunk"), ["dim", "pivot", "chunk"]).repartition(tasks, *keys)
    reach = _reach(floor)

    def blocks(d: pd.DataFrame, pivot: str, chunk: str) -> list[tuple]:
        made = []
        for _, part in d.groupby([pivot, chunk]):
            unit = np.stack(part["unit"].to_list())
            made.append((part["id"].to_numpy(), unit, *_cone(unit)))
        return made

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = [(a["id"].to_numpy()[:0], b["id"].to_numpy()[:0], np.zeros(0))]
        theirs = blocks(b, "pivot", "chunk")
        for q_id, q_unit, q_centre, q_radius in blocks(a, "q_pivot", "q_chunk"):
            for r_id, r_unit, centre, radius in theirs:
                if np.arccos(np.clip(q_centre @ centre, -1, 1)) - q_radius - radius > reach:
                    continue
                dots = np.clip(q_unit @ r_unit.T, -1, 1)
                i, j = np.nonzero(dots >= floor)
                found.append((q_id[i], r_id[j], dots[i, j]))
        q_ids, r_ids, dots = (np.concatenate(x) for x in zip(*found, strict=True))
        return pd.DataFrame({"query_id": q_ids, "record_id": r_ids, "semantic": dots})

    schema = (f"query_id {queries.schema['query_id'].dataType.simpleString()}, "
              f"record_id {records.schema['record_id'].dataType.simpleString()}, semantic double")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(product, schema)


def index_records(records: DataFrame) -> DataFrame:
    """Term counts per record: record_id, token, tf, dl. One row with an empty token per record."""
    docs = records.select("record_id", T.retrieval_tokens(F.col("text")).alias("tokens"))
    terms = docs.select("record_id", F.size("tokens").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "tokens")).alias("token"))
    return terms.groupBy("record_id", "token").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def search(records: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """Top matches per query, scores with six places; see ``scored_matches``."""
    return scored_matches(records, queries, limit).select(
        "query_id", "record_id", "rank", *[F.bround(c, 6).alias(c) for c in (
            "score", "semantic_score", "lexical_score", "lexical_coverage")], "match_mode")


def scored_matches(records: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """Top matches per query with full scores, for records that are searched once.

    ``search_index`` keeps an index for records that are searched again.

    ``records`` (already filtered by outcome, because the filter changes the statistics):
    record_id, text, r_vec (nullable array). ``queries``: query_id, query, q_vec (nullable).
    Lexical candidates share enough of the query's rarest tokens, semantic candidates reach
    the similarity floor; scores are computed for those pairs only, and no pair outside
    them can pass the gates.
    """
    postings = cut_lineage(index_records(records))
    qs = queries.select("query_id", T.retrieval_tokens(F.col("query")).alias("q_tokens")).filter(F.size("q_tokens") > 0)
    # Every record keeps one row with an empty token, so texts without tokens still count.
    stats = postings.filter(F.col("token") == "").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    postings = postings.filter(F.col("token") != "")
    df = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))

    unique = qs.select("query_id", F.array_distinct("q_tokens").alias("tokens"))
    need = F.greatest(F.ceil(F.size("tokens") * X.MIN_COVERAGE),
                      F.when(F.size("tokens") <= 2, 1).otherwise(2)).cast("int")
    lexical = candidate_pairs(unique, ["query_id"], need, postings.select("record_id", "token"), ["record_id"])
    pairs = lexical
    if "r_vec" in records.columns and "q_vec" in queries.columns:
        # callers apply the exact test; the floor is lowered by a hair here
        semantic = similar_pairs(queries.select("query_id", "q_vec"), records.select("record_id", "r_vec"), X.MIN_SEMANTIC - 1e-9)
        pairs = lexical.unionByName(semantic.select("query_id", "record_id").join(qs.select("query_id"), "query_id", "left_semi")).distinct()

    terms = qs.select("query_id", F.explode("q_tokens").alias("token")).groupBy("query_id", "token").agg(
        F.count(F.lit(1)).alias("qtf"))
    sizes = unique.select("query_id", F.size("tokens").alias("n_terms"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = terms.join(df, "token").join(F.broadcast(stats)).select(
        "query_id", "token", "qtf", idf.alias("idf"), "avgdl")
    length = X.BM25_K1 * ((1 - X.BM25_B) + X.BM25_B * F.col("dl") / F.greatest(F.lit(1.0), F.col("avgdl")))
    gain = F.col("qtf") * F.col("idf") * F.col("tf") * (X.BM25_K1 + 1) / (F.col("tf") + length)
    scored = (
        # Keyed by (record, token): no common token becomes a hot join key.
        pairs.join(weights, "query_id").join(postings, ["record_id", "token"])
        .groupBy("query_id", "record_id").agg(F.sum(gain).alias("raw"), F.count(F.lit(1)).alias("matched"))
    )
    d = pairs.join(scored, ["query_id", "record_id"], "left").join(sizes, "query_id")
    raw = F.coalesce("raw", F.lit(0.0))
    d = d.withColumn("lexical", F.when(raw > 0, raw / (raw + 2.0)).otherwise(0.0)).withColumn(
        "matched", F.coalesce("matched", F.lit(0))).withColumn("coverage", F.col("matched") / F.col("n_terms"))
    if "r_vec" in records.columns and "q_vec" in queries.columns:
        d = d.join(records.select("record_id", "r_vec"), "record_id").join(
            queries.select("query_id", "q_vec"), "query_id").withColumn(
            "semantic", cosine(F.col("q_vec"), F.col("r_vec")))
    else:
        d = d.withColumn("semantic", F.lit(None).cast("double"))
    required = F.when(F.col("n_terms") <= 2, 1).otherwise(2)
    lexical_pass = ((F.col("lexical") >= X.MIN_LEXICAL) & (F.col("coverage") >= X.MIN_COVERAGE)
                    & (F.col("matched") >= required))
    d = d.withColumn("score", X.LEXICAL_WEIGHT * F.col("lexical") + F.coalesce(
        X.SEMANTIC_WEIGHT * F.greatest(F.lit(0.0), F.col("semantic")), F.lit(0.0)))
    semantic_pass = F.coalesce((F.col("semantic") >= X.MIN_SEMANTIC) & (F.col("score") >= X.MIN_HYBRID), F.lit(False))
    d = d.filter(semantic_pass | lexical_pass).withColumn(
        "mode", F.when(semantic_pass, "hybrid").otherwise("lexical_exact"))
    # Equal texts must tie: sums of the same terms may differ in the last digits.
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "record_id")
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select(
        "query_id", "record_id", "rank", "score", F.col("semantic").alias("semantic_score"),
        F.col("lexical").alias("lexical_score"), F.col("coverage").alias("lexical_coverage"), F.col("mode").alias("match_mode"))


# --- sections -----------------------------------------------------------------------------

def sections(documents: DataFrame) -> DataFrame:
    """Heading-delimited sections of Markdown text. ``documents``: doc_id, text.

    A section runs to the next heading of the same or a higher level; it is a leaf if the
    next heading is not deeper.
    """
    # Cut in front of every heading line; the piece before the first one is no section.
    pieces = F.split("text", r"(?m)(?=^#{1,6}\s+\S)")
    head = r"^(#{1,6})\s+(.+?)[^\S\n]*(?:\n|$)"
    headed = F.filter(F.transform(pieces, lambda p, i: F.struct(p.alias("piece"), i.alias("pos"))), lambda p: p["piece"].rlike(head))
    levels = F.transform("headed", lambda p: F.length(F.regexp_extract(p["piece"], head, 1)))
    texts = F.transform("headed", lambda p: p["piece"])
    d = documents.select("doc_id", headed.alias("headed")).select("doc_id", "headed", levels.alias("levels"), texts.alias("texts"))

    def section(p: Column, i: Column) -> Column:
        level = F.get("levels", i)
        # the section ends before the next one of its level or above, else with the text
        later = F.slice("levels", i + 2, F.greatest(F.size("levels") - i - 1, F.lit(0)))
        stop = F.coalesce(F.array_min(F.filter(F.transform(later, lambda n, k: F.when(n <= level, k)), lambda k: k.isNotNull())), F.size(later))
        return F.struct(p["pos"].alias("pos"), level.alias("level"), strip(F.regexp_extract(p["piece"], head, 2)).alias("heading"),
                        F.array_join(F.slice("texts", i + 1, stop + 1), "").alias("content"), (stop == 0).alias("is_leaf"))

    d = d.select("doc_id", F.inline(F.transform("headed", section))).withColumn("_slug", T.slug(F.col("heading")))
    twin = Window.partitionBy("doc_id", "_slug").orderBy("pos")
    d = d.withColumn("_copy", F.row_number().over(twin))
    return d.select("doc_id", "pos", F.when(F.col("_copy") == 1, F.col("_slug")).otherwise(
        F.concat_ws("-", "_slug", F.col("_copy").cast("string"))).alias("section_id"),
        "heading", "level", "content", "is_leaf")


def rank_sections(secs: DataFrame, queries: DataFrame, limit: int = 4) -> DataFrame:
    """Best sections of the document each query belongs to. ``queries``: doc_id, query."""
    q = queries.select("doc_id", T.section_tokens(F.col("query")).alias("q")).filter(F.size("q") > 0)
    overlap = lambda c: F.size(F.array_intersect("q", T.section_tokens(F.col(c))))
    d = secs.join(q, "doc_id").withColumn("score", overlap("heading") * 4 + overlap("content")).filter("score > 0")
    per_doc = Window.partitionBy("doc_id")
    d = d.withColumn("_leaf", F.bool_or("is_leaf").over(per_doc)).filter(F.col("is_leaf") | ~F.col("_leaf"))
    d = d.withColumn("_best", F.max("score").over(per_doc))
    d = d.filter(F.col("score") >= F.greatest(F.lit(2), F.floor((F.col("_best") + 1) / 2)))
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "pos")
    return d.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select(
        "doc_id", "rank", "section_id", "heading", "score")


def hashed_vectors(texts: DataFrame, text_column: str, dims: int = 1024, vectorizer=None, copies: str | None = None) -> DataFrame:
    """Unit vectors of text, from a user-supplied ``pandas_udf`` or hashed TF-IDF (weights above zero).

    ``copies``: a column with the number of texts that a row stands for; document frequencies count them all.
    """
    if vectorizer is not None:
        return texts.withColumn("vector", vectorizer(F.col(text_column)))
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    n = F.lit(1) if copies is None else F.col(copies)
    d = texts.withColumn("_tokens", T.retrieval_tokens(F.col(text_column)))
    d = HashingTF(inputCol="_tokens", outputCol="_vector", numFeatures=dims).transform(d)
    d = staged(d, _tf=vector_to_array("_vector"))
    # one row: the number of texts with each of the ``dims`` hashes
    places = F.filter(F.transform("_tf", lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    found = d.select(n.alias("n"), F.explode(places).alias("place")).groupBy("place").agg(F.sum("n").alias("n"))
    found = found.agg(F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("found")).crossJoin(texts.agg(F.sum(n).alias("all")))
    weights = found.select(F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.log((F.col("all") + 1.0) / (F.coalesce(F.col("found")[i], F.lit(0)) + 1.0))).alias("_weights"))
    d = d.crossJoin(F.broadcast(weights)).withColumn("_idf", F.zip_with("_tf", "_weights", lambda x, w: x * w))
    # Counts are added to the weighted counts: a token that every text has still counts a little.
    d = staged(d, _sum=F.zip_with("_tf", "_idf", lambda x, y: x + y))
    d = staged(d, _size=F.greatest(F.sqrt(F.aggregate("_sum", F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12)))
    return d.withColumn("vector", F.transform("_sum", lambda x: (x / F.col("_size")).cast("float"))).drop(
        "_tokens", "_vector", "_tf", "_weights", "_idf", "_sum", "_size")
