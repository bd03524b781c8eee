"""Lexical ranking: term statistics, BM25, and the two rankings built on it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.functions.text import tokens
from fathomline.operators.dense import BLOCK, FOUND, Best, binary, found_rows, joined_bytes, kth_bound, merged
from fathomline.session import broadcast_below, materialize

K1, B = 1.5, 0.75
#: Bytes of a table that is broadcast at most.
BROADCAST_BYTES = 64 << 20
#: Queries that meet a block of documents at once.
QUERIES_AT_ONCE = 4_096
#: Pairs of a query and a term that the driver holds at most, as numbers.
ASKED_PAIRS = 16_000_000
#: The share of pairs of a block from which a term's part is a product of matrices; hits and pairs that are added up at once.
DENSE_SHARE, HITS_AT_ONCE, PAIRS_AT_ONCE = 0.0025, 2_000_000, 20_000
#: The share of pairs of a block from which they are added up again all together.
MANY_PAIRS = 0.01
#: Scores are rounded to 6 digits before they are ranked; bounds leave that much room.
ROOM = 1e-5


def bounded(df: DataFrame) -> DataFrame:
    """A written table, with the broadcast hint if it is small enough."""
    return broadcast_below(df, BROADCAST_BYTES)


def limited(long: DataFrame, column: str, terms: DataFrame) -> DataFrame:
    """Rows of ``long`` whose ``column`` is one of the terms (a written column of that name) or empty. Few
    terms are broadcast; many are joined by shuffle, without the empty ones, which every record has."""
    small = bounded(terms)
    if small is not terms:
        empty = terms.sparkSession.createDataFrame([("",)], f"{column} string")
        return long.join(F.broadcast(terms.select(column).union(empty)), column, "left_semi")
    return long.where(F.col(column) != "").join(terms, column, "left_semi").unionByName(long.where(F.col(column) == ""))


def term_table(docs: DataFrame, id_col: str, text: Column, mode: str = "server", terms: DataFrame | None = None) -> DataFrame:
    """(id, len, token, tf), and a row of the empty token per document. ``terms``(token) limits the
    tokens. Null texts have length 0."""
    found = docs.select(F.col(id_col).alias("id"), tokens(text, mode).alias("found"))
    long = found.select("id", F.size("found").alias("len"), F.explode(F.concat("found", F.array(F.lit("")))).alias("token"))
    if terms is not None:
        long = limited(long, "token", terms)
    return long.groupBy("id", "len", "token").agg(F.count(F.lit(1)).alias("tf"))


def query_terms(queries: DataFrame, id_col: str, text: Column, mode: str = "server") -> DataFrame:
    """(q_id, token): the distinct terms of each query."""
    return queries.select(F.col(id_col).alias("q_id"), F.explode(F.array_distinct(tokens(text, mode))).alias("token"))


def weighed(docs: DataFrame, id_col: str, text: Column, asked: DataFrame, mode: str = "server") -> tuple[DataFrame, DataFrame]:
    """(postings, wanted) for terms asked for (q_id, token): postings(id, token, w) have the document's part
    of a term's score, wanted(q_id, token, idf, df, most) the query's and the most that the term can add.
    N and the mean length are over all documents, empty ones included."""
    terms = materialize(asked.select("token").distinct())
    table = materialize(term_table(docs, id_col, text, mode, terms))
    n, total = table.where("token = ''").agg(F.count(F.lit(1)), F.sum("len")).first()
    mean = (total or 0) / n if n else 1.0
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(mean or 1.0)))
    postings = table.where("token <> ''").select("id", "token", part.alias("w"))
    stats = materialize(postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.max("w").alias("w")))
    idf = F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return postings, materialize(asked.join(bounded(stats), "token").select("q_id", "token", idf.alias("idf"), "df", (idf * F.col("w")).alias("most")))


def scores(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """(q_id, id, score) over the given terms of the queries."""
    return postings.join(bounded(wanted), "token").groupBy("q_id", "id").agg(F.sum(F.col("idf") * F.col("w")).alias("score"))


def bm25(docs: DataFrame, id_col: str, text: Column, asked: DataFrame, mode: str = "server") -> DataFrame:
    """(q_id, id, score): the BM25 score, rounded to 6 digits, of every document with a query term."""
    return scores(*weighed(docs, id_col, text, materialize(asked), mode)).withColumn("score", F.round("score", 6))


def _whole(*columns: T.StructField) -> bool:
    return all(f.dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") for f in columns)


def bm25_top(docs: DataFrame, id_col: str, text: Column, asked: DataFrame, k: int, mode: str = "server") -> DataFrame:
    """(q_id, id, score, rk): the k best documents of each query by ``bm25``, ties by id. No row is made of a
    pair that isn't among the best of its task: queries of up to ASKED_PAIRS terms together, whose distinct terms
    fit the broadcast bound, meet the documents in blocks (``_top_in_blocks``); more of them, or ids that aren't
    whole numbers, are joined."""
    asked = materialize(asked)
    if _whole(docs.schema[id_col], asked.schema["q_id"]) and (terms := _few_terms(asked)) is not None:
        return _top_in_blocks(docs, id_col, text, asked, terms, k, mode)
    return _top_by_joins(docs, id_col, text, asked, k, mode)


def bm25_top_by_part(docs: DataFrame, id_col: str, text: Column, asked: DataFrame, k: int, part: str, first: int, mode: str = "server") -> DataFrame:
    """(q_id, part, id, score, rk): the k best documents of each query within each of the ``first`` parts by name
    that hold a term asked for. ``part`` is a text; documents without one count in the statistics only."""
    asked = materialize(asked)
    if _whole(docs.schema[id_col], asked.schema["q_id"]) and (terms := _few_terms(asked)) is not None:
        return _top_in_blocks(docs, id_col, text, asked, terms, k, mode, part, first)
    scored = bm25(docs, id_col, text, asked, mode).join(docs.select(F.col(id_col).alias("id"), F.col(part).alias("part")), "id").where("part is not null")
    best = Window.partitionBy("q_id", "part").orderBy(F.desc("score"), "id")
    scored = scored.withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= k)
    return scored.join(F.broadcast(scored.select("part").distinct().orderBy("part").limit(first)), "part").select("q_id", "part", "id", "score", "rk")


def _few_terms(asked: DataFrame) -> pa.Array | None:
    """The distinct terms asked for (a written table), if blocks can take them."""
    if asked.count() > ASKED_PAIRS:
        return None
    terms = materialize(asked.select("token").distinct())
    return None if bounded(terms) is terms else terms.toArrow()["token"].combine_chunks()


def _runs(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the runs."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


class _Asking:
    """A block of queries: pairs of a query and a term's code, by query. Scores of a block of documents come
    from a product of matrices over the terms that many queries and documents have, and from single hits of the
    others, in single precision; those that may be among the best are added up again in double, one by one or,
    if they are many, by a product of all."""

    def __init__(self, q: np.ndarray, code: np.ndarray, size: int, idf: np.ndarray) -> None:
        self.q, self.code, self.size, self.idf, self.terms = q, code, size, idf, len(idf)
        self.many = np.bincount(code, minlength=self.terms)
        # A sum of n positive terms is right to about n units in the last place.
        self.slack = (np.bincount(q, minlength=size) + 8) * 2.0**-23
        self.has: np.ndarray | None = None
        if size * self.terms <= HITS_AT_ONCE * 32:
            self.has = np.zeros((size, self.terms), bool)
            self.has[q, code] = True
        self.keys = q.astype(np.int64) * self.terms + code

    def scores(self, doc: np.ndarray, code: np.ndarray, w: np.ndarray, docs: int, kind: type = np.float32) -> np.ndarray:
        """(queries x docs) of the postings (doc, code, w)."""
        here = np.bincount(code, minlength=self.terms)
        dense = np.flatnonzero(here * self.many > DENSE_SHARE * self.size * docs)
        place = np.full(self.terms, -1)
        place[dense] = np.arange(len(dense))
        if len(dense):
            left, right = np.zeros((self.size, len(dense)), kind), np.zeros((len(dense), docs), kind)
            mine, own = place[self.code] >= 0, place[code] >= 0
            left[self.q[mine], place[self.code[mine]]] = self.idf[self.code[mine]]
            right[place[code[own]], doc[own]] = w[own]
            score = left @ right
        else:
            score = np.zeros((self.size, docs), kind)
        flat, rare = score.reshape(-1), place[code] < 0
        by_code = np.argsort(code[rare], kind="stable")
        doc, w = doc[rare][by_code], (w * self.idf[code])[rare][by_code].astype(kind)
        start = np.append(0, np.cumsum(np.where(place < 0, here, 0)))
        single = np.flatnonzero((place[self.code] < 0) & (here[self.code] > 0))
        q, code = self.q[single], self.code[single]
        hits = np.cumsum(here[code])
        for low in range(0, int(hits[-1]) if len(hits) else 0, HITS_AT_ONCE):
            some = slice(*np.searchsorted(hits, [low, low + HITS_AT_ONCE], "right")) if low else slice(0, np.searchsorted(hits, HITS_AT_ONCE, "right"))
            n = here[code[some]]
            at = np.repeat(start[code[some]], n) + _runs(n)
            np.add.at(flat, np.repeat(q[some] * docs, n) + doc[at], w[at])
        return score

    def exact(self, q: np.ndarray, d: np.ndarray, first: np.ndarray, code: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The scores of pairs; postings (code, w) lie by document, that of d from first[d] to first[d + 1]."""
        out = np.empty(len(q))
        for low in range(0, len(q), PAIRS_AT_ONCE):
            mine, of = q[low : low + PAIRS_AT_ONCE], d[low : low + PAIRS_AT_ONCE]
            n = first[of + 1] - first[of]
            at, asking = np.repeat(first[of], n) + _runs(n), np.repeat(mine, n)
            if self.has is not None:
                hit = self.has[asking, code[at]]
            else:
                key = asking.astype(np.int64) * self.terms + code[at]
                hit = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key
            at = at[hit]
            out[low : low + PAIRS_AT_ONCE] = np.bincount(np.repeat(np.arange(len(of)), n)[hit], self.idf[code[at]] * w[at], len(of))
        return out


def _top_in_blocks(docs: DataFrame, id_col: str, text: Column, asked: DataFrame, terms: pa.Array, k: int, mode: str, part: str | None = None, first: int = 0) -> DataFrame:
    """Documents are written once as the codes and counts of the terms asked for. A task then scores blocks of
    documents for its block of queries, and keeps the k best of each query (and part). Blocks of queries are
    tasks of their own, so that few tasks return candidates for the same query."""
    spark, kind, size = docs.sparkSession, docs.schema[id_col].dataType.simpleString(), len(terms)

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["q_id"].cast(pa.int64()), pc.index_in(batch["token"], terms).cast(pa.int32())], names=["q_id", "code"])

    pairs = asked.where("q_id is not null").select("q_id", "token").mapInArrow(asking, "q_id bigint, code int").toArrow()  # ASKED_PAIRS at most
    code = pairs["code"].to_numpy()
    queries, q = np.unique(pairs["q_id"].to_numpy(), return_inverse=True)
    order = np.lexsort((code, q))
    q, code = q[order].astype(np.int32), code[order]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch["found"]
            at = pc.index_in(found.flatten(), terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = pc.list_parent_indices(found).to_numpy()
            key, tf = np.unique((row * (size + 1) + at)[at >= 0], return_counts=True)
            ends = np.searchsorted(key, np.arange(batch.num_rows + 1) * (size + 1)) * 4
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["part"], pc.fill_null(pc.list_value_length(found), 0), binary((key % (size + 1)).astype("<i4"), ends), binary(tf.astype("<i4"), ends)], names=["id", "part", "len", "codes", "tfs"]
            )

    rows = docs.select(F.col(id_col).alias("id"), (F.col(part) if part else F.lit("")).cast("string").alias("part"), tokens(text, mode).alias("found"))
    written = materialize(rows.mapInArrow(coded, f"id {kind}, part string, len int, codes binary, tfs binary"))
    n, total = written.agg(F.count(F.lit(1)), F.sum("len")).first()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(joined_bytes(batch["codes"]), "<i4"), minlength=size)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], names=["code", "df"])

    df = np.zeros(size)
    for c, many in written.mapInArrow(counted, "code int, df bigint").groupBy("code").agg(F.sum("df")).collect():  # a row per term asked for
        df[c] = many
    idf, mean = np.log1p((n - df + 0.5) / (df + 0.5)), ((total or 0) / n if n else 1.0) or 1.0
    ranked = written.where("octet_length(codes) > 0")
    names = [""]
    if part:
        names = [r[0] for r in ranked.where("part is not null").select("part").distinct().orderBy("part").limit(first).collect()]
        ranked = ranked.where(F.col("part").isin(names))
    parts = pa.array(names, pa.string())

    def best_of(low: int, high: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """The best of the queries from low to high."""
        bounds = np.append(np.arange(low, high, QUERIES_AT_ONCE), high)
        cuts = np.searchsorted(q, bounds)
        blocks = [(q[s:e] - b, code[s:e], int(n)) for b, n, s, e in zip(bounds[:-1], np.diff(bounds), cuts[:-1], cuts[1:], strict=True)]

        def best_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked_here = [_Asking(*block, idf) for block in blocks]
            best = [[Best(block.size, k) for _ in names] for block in asked_here]
            step = max(1, 2 * BLOCK // min(QUERIES_AT_ONCE, max(1, high - low)))
            for batch in batches:
                for begin in range(0, batch.num_rows, step):
                    some = batch.slice(begin, step)
                    home = pc.index_in(some["part"], parts).to_numpy(zero_copy_only=False).astype(np.int64)
                    by_part = np.argsort(home, kind="stable")
                    some, home = some.take(pa.array(by_part)), home[by_part]
                    ids, own = some["id"].to_numpy().astype(np.int64), some["codes"].to_pylist()
                    lengths = np.fromiter((len(c) // 4 for c in own), np.int64, len(own))
                    codes, tf, doc = np.frombuffer(b"".join(own), "<i4"), np.frombuffer(joined_bytes(some["tfs"]), "<i4"), np.repeat(np.arange(len(ids)), lengths)
                    w = tf * (K1 + 1) / (tf + K1 * (1 - B + B * some["len"].to_numpy()[doc] / mean))
                    at = np.append(0, np.cumsum(lengths))
                    edges = np.searchsorted(home, np.arange(len(names) + 1))
                    for block, kept in zip(asked_here, best, strict=True):
                        score = block.scores(doc, codes, w, len(ids))
                        held = np.unique(home)
                        pairs = [_candidates(block, kept[p], score[:, edges[p] : edges[p + 1]]) for p in held]
                        row, column = np.concatenate([r for r, _ in pairs]), np.concatenate([c + edges[p] for p, (_, c) in zip(held, pairs, strict=True)])
                        if len(row) > MANY_PAIRS * score.size:
                            value = block.scores(doc, codes, w, len(ids), np.float64)[row, column]
                        else:
                            value = block.exact(row, column, at, codes, w)
                        cut = np.cumsum([len(r) for r, _ in pairs])[:-1]
                        for p, r, c, v in zip(held, np.split(row, cut), np.split(column, cut), np.split(value, cut), strict=True):
                            kept[p].add_pairs(r, ids[c], v)
                            if kept[p].count > 1.5 * kept[p].pruned + block.size:
                                kept[p].prune()
            for b, kept in zip(bounds[:-1], best, strict=True):
                for p, own in enumerate(kept):
                    yield from found_rows((b + np.arange(len(own.bound))) * len(names) + p, *own.lists()).to_batches()

        return best_here

    cores = max(1, spark.sparkContext.defaultParallelism)
    tasks = min(64, max(1, -(-len(queries) // QUERIES_AT_ONCE)))
    bounds = np.linspace(0, len(queries), tasks + 1).astype(np.int64)
    around = -(-2 * cores // tasks)
    found = reduce(DataFrame.unionByName, [ranked.select("id", "part", "len", "codes", "tfs").coalesce(around).mapInArrow(best_of(int(low), int(high)), FOUND) for low, high in pairwise(bounds)])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch["id"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(queries[key // len(names)]), parts.take(pa.array(key % len(names))), batch["other"], batch["score"], batch["rk"]], names=["q_id", "part", "id", "score", "rk"])

    out = merged(found, k).mapInArrow(named, "q_id bigint, part string, id bigint, score double, rk int")
    return out if part else out.drop("part")


def _candidates(block: _Asking, best: Best, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, document) of the scores that can be among the best."""
    sure = best.bound.copy()
    if len(fresh := np.flatnonzero(np.isneginf(sure))):
        sure[fresh] = kth_bound(score if len(fresh) == len(sure) else score[fresh], best.k) * (1 - block.slack[fresh]) - ROOM
    least = np.maximum(sure * (1 - block.slack) - ROOM, 1e-30)  # a pair without a common term has no score
    return np.divmod(np.flatnonzero((score >= least[:, None].astype(np.float32)).reshape(-1)), score.shape[1])


def _top_by_joins(docs: DataFrame, id_col: str, text: Column, asked: DataFrame, k: int, mode: str, seeds: int = 64) -> DataFrame:
    """Without scoring all documents that share a word with a query, and yet exact:

    1. The rarest terms of a query, with up to ``seeds`` * k postings, are scored, and the scores of the best
       documents by them completed; the k-th best of these is a score that the k-th best document reaches.
    2. A query's terms of least weight that together stay below it can't make a document one of the best:
       only documents with another term are candidates, and of them those that could still reach it.
    3. The candidates' scores are completed with the terms left aside.
    """
    postings, wanted = weighed(docs, id_col, text, asked, mode)
    rare_first = Window.partitionBy("q_id").orderBy("df", "token")
    wanted = wanted.withColumn("so_far", F.sum("df").over(rare_first.rowsBetween(Window.unboundedPreceding, 0)))
    first = materialize(wanted.where((F.col("so_far") <= seeds * k) | (F.col("so_far") == F.col("df"))))
    some = top(scores(postings, first), 4 * k).select("q_id", "id")
    best = top(completed(materialize(some), wanted, postings), k).groupBy("q_id").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n"))
    reached = best.select("q_id", F.when(F.col("n") >= k, F.col("score")).otherwise(0.0).alias("reached"))
    light_first = Window.partitionBy("q_id").orderBy("most", "token")
    of_query = Window.partitionBy("q_id")
    split = wanted.join(reached, "q_id").withColumn("aside", F.sum("most").over(light_first.rowsBetween(Window.unboundedPreceding, 0)) < F.col("reached") - ROOM)
    needed = F.col("reached") - F.coalesce(F.sum(F.when(F.col("aside"), F.col("most"))).over(of_query), F.lit(0.0)) - ROOM
    split = materialize(split.select("q_id", "token", "idf", "aside", needed.alias("needed")))
    found = postings.join(bounded(split.where("not aside")), "token").groupBy("q_id", "id").agg(F.sum(F.col("idf") * F.col("w")).alias("score"), F.first("needed").alias("needed"))
    candidates = materialize(found.where("score >= needed").select("q_id", "id", "score"))
    rest = completed(candidates.select("q_id", "id"), split.where("aside"), postings)
    return top(candidates.unionByName(rest).groupBy("q_id", "id").agg(F.round(F.sum("score"), 6).alias("score")), k)


def completed(pairs: DataFrame, wanted: DataFrame, postings: DataFrame) -> DataFrame:
    """(q_id, id, score) of the pairs over the given terms of their queries; pairs without one have no row.
    The pairs meet the postings of their documents, so frequent terms are read for them alone."""
    terms = pairs.join(bounded(wanted.select("q_id", "token", "idf")), "q_id")
    return terms.join(postings, ["id", "token"]).groupBy("q_id", "id").agg(F.sum(F.col("idf") * F.col("w")).alias("score"))


def top(scored: DataFrame, k: int, by: str = "q_id", score: str = "score", tie: str = "id") -> DataFrame:
    """scored with ``rk`` from 1: the k best of each query, ties by position."""
    best = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return scored.withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= k)


def evaluator_top(scored: DataFrame, docs: DataFrame, id_col: str, queries: DataFrame, q_col: str, k: int = 50) -> DataFrame:
    """As ``top``, but documents of score 0 take part, by position: the first k positions are enough.
    ``scored`` may be the k best alone: of a query with fewer it has all."""
    first = [r[0] for r in docs.select(id_col).orderBy(id_col).limit(k).collect()]
    kind = docs.schema[id_col].dataType.simpleString()
    empty = queries.select(F.col(q_col).alias("q_id"), F.explode(F.array(*(F.lit(x).cast(kind) for x in first)) if first else F.array().cast(f"array<{kind}>")).alias("id"))
    empty = empty.join(scored, ["q_id", "id"], "left_anti").withColumn("score", F.lit(0.0))
    return top(scored.unionByName(empty), k)
