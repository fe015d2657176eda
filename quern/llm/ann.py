"""Approximate maximum inner product search with score-aware anisotropic quantisation.

Equal vectors are one index entry that remembers its smallest ids. Entries
are filed under coarse centres; what a centre leaves over is scaled to
length one and quantised in blocks of two dimensions to four bits each. Codes and code books minimise the
anisotropic loss, in which error along a vector, which shifts its scores,
weighs more than error across it. A query scans the four-bit tables of the
files it probes; the best entries are reranked by the exact product.

Centres and code books are fitted on a bounded sample; every vector is
indexed. How many files a query probes is set on the sample too: as many as
hold nearly all exact neighbours of sampled queries. Queries are dealt into lots; all pieces that a lot probes pass
one worker, which keeps each query's best of them all, so what goes on grows with the queries alone. What a worker
holds does not grow with the vectors or centres.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import small, stage_table

#: Vectors that centres and code books are fitted on, at most.
FIT_ROWS = 20_000
NEAREST = 20
#: Share of true neighbours, of sampled queries within the sample, whose files must be among those probed.
PROBED_SHARE = 0.98
PROBE_QUERIES = 128
#: Entries a centre should hold; the number of centres follows from it, within bounds.
PER_CENTRE = 1024
CENTRES = (16, 4096)
PIECE = 4096
QUERY_GROUP = 256
#: Best entries of a query, of all files that it probes, that go on to the exact product.
RERANK = 200
#: Queries whose best are held while all pieces that they probe go by, QUERY_GROUP of them scanned at a time.
LOT = 2048
BLOCK = 2
WORDS = 16
#: Squared cosine from which on a query counts as close to a vector.
THRESHOLD = 0.2
#: Entries of a matrix of products that are held at a time.
CELLS = 1 << 20
#: Query vectors, one for each file probed, that leave a worker at a time.
SENT = 1 << 14


def _steps(rows: int, width: int, cells: int) -> list[slice]:
    """Slices of ``rows`` rows that hold ``cells`` entries of ``width`` columns each, or one row."""
    step = max(1, cells // max(1, width))
    return [slice(at, at + step) for at in range(0, rows, step)]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each vector."""
    norms = (centres**2).sum(1)[None, :]
    return np.concatenate([np.zeros(0, np.int64), *(np.argmin(norms - 2 * x[s] @ centres.T, axis=1) for s in _steps(len(x), len(centres), CELLS))])


@dataclass
class Quantiser:
    centres: np.ndarray  # centres x dim
    books: np.ndarray  # blocks x WORDS x BLOCK
    eta: float  # weight of parallel over orthogonal error, less one
    probes: int = 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The nearest centre of each vector."""
        return _nearest(x, self.centres)

    def probed(self, queries: np.ndarray) -> np.ndarray:
        """The files that each query probes, best first: queries x probes."""
        best = [np.argsort(-(queries[s] @ self.centres.T), axis=1, kind="stable")[:, : self.probes].copy() for s in _steps(len(queries), len(self.centres), CELLS)]
        return np.concatenate([np.zeros((0, min(self.probes, len(self.centres))), np.int64), *best])

    def encode(self, x: np.ndarray, at: np.ndarray, sweeps: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """Code words by coordinate descent on the anisotropic loss (rows x blocks), and the scale of each row."""
        rest, scale = _scaled(x - self.centres[at])
        return _codes(rest, _along(x), self.books, self.eta, sweeps), scale

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Products of each query's blocks with all code words: queries x blocks x WORDS."""
        return np.einsum("qbd,bwd->qbw", queries.reshape(len(queries), -1, BLOCK), self.books)


def _scaled(rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rests in blocks, at length one, and their lengths: a dense group keeps as fine codes as a wide one."""
    scale = np.linalg.norm(rest, axis=1)
    return (rest / np.maximum(scale, 1e-30)[:, None]).reshape(len(rest), -1, BLOCK), scale


def _along(x: np.ndarray) -> np.ndarray:
    """Unit vectors, in blocks."""
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)).reshape(len(x), -1, BLOCK)


def _codes(rest: np.ndarray, unit: np.ndarray, books: np.ndarray, eta: float, sweeps: int) -> np.ndarray:
    blocks = rest.shape[1]
    plain = ((rest[:, :, None, :] - books[None]) ** 2).sum(-1)
    codes = plain.argmin(-1)
    along = np.einsum("nbd,nbd->nb", rest - books[np.arange(blocks)[None], codes], unit)
    total = along.sum(1)
    for _ in range(sweeps):
        for b in range(blocks):
            left = np.einsum("nwd,nd->nw", rest[:, b, None, :] - books[b][None], unit[:, b])
            loss = plain[:, b] + eta * ((total - along[:, b])[:, None] + left) ** 2
            best = loss.argmin(1)
            codes[:, b] = best
            new = left[np.arange(len(rest)), best]
            total += new - along[:, b]
            along[:, b] = new
    return codes


def _kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    picked = [int(rng.integers(len(x)))]
    far = np.full(len(x), np.inf)
    for _ in range(k - 1):  # seeds far from those before
        far = np.minimum(far, ((x - x[picked[-1]]) ** 2).sum(1))
        total = far.sum()
        picked.append(int(rng.choice(len(x), p=far / total)) if total > 0 else picked[0])
    centres = x[picked].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        counts = np.bincount(at, minlength=len(centres))
        for j in range(x.shape[1]):
            sums = np.bincount(at, x[:, j], len(centres))
            centres[:, j] = np.where(counts > 0, sums / np.maximum(counts, 1), centres[:, j])
    return centres


def fit(sample: np.ndarray, entries: int, sweeps: int = 4) -> Quantiser:
    """Centres for ``entries`` vectors and code books, from a sample."""
    dim = sample.shape[1]
    pad = -dim % BLOCK
    x = np.pad(sample, ((0, 0), (0, pad)))
    k = int(min(max(CENTRES[0], 2 ** int(np.ceil(np.log2(max(1, entries / PER_CENTRE))))), CENTRES[1], len(x)))
    centres = _kmeans(x, k)
    eta = max(1.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2)) - 1
    q = Quantiser(centres, np.zeros((x.shape[1] // BLOCK, WORDS, BLOCK)), eta)
    rest, _ = _scaled(x - centres[q.assign(x)])
    unit = _along(x)
    for b in range(rest.shape[1]):
        found = _kmeans(rest[:, b], min(WORDS, len(x)))
        q.books[b, : len(found)] = found
        q.books[b, len(found) :] = found[0]
    for _ in range(sweeps):
        codes = _codes(rest, unit, q.books, eta, 1)
        along = np.einsum("nbd,nbd->nb", rest - q.books[np.arange(rest.shape[1])[None], codes], unit)
        total = along.sum(1)
        for b in range(rest.shape[1]):
            u, r = unit[:, b], rest[:, b]
            others = total - along[:, b]
            for w in range(WORDS):
                own = codes[:, b] == w
                if own.any():  # least squares of the loss in this code word
                    left = own.sum() * np.eye(BLOCK) + eta * u[own].T @ u[own]
                    right = r[own].sum(0) + eta * u[own].T @ (others[own] + np.einsum("nd,nd->n", r[own], u[own]))
                    q.books[b, w] = np.linalg.solve(left, right)
            new = np.einsum("nd,nd->n", r - q.books[b][codes[:, b]], u)
            total += new - along[:, b]
            along[:, b] = new
    q.probes = _probes_needed(q, x)
    return q


def _probes_needed(q: Quantiser, x: np.ndarray) -> int:
    """Centres to probe so that PROBED_SHARE of exact neighbours of sampled queries are met."""
    asked = x[:: max(1, len(x) // PROBE_QUERIES)][:PROBE_QUERIES]
    scores = asked @ x.T
    scores[np.arange(len(asked)), np.arange(0, len(x), max(1, len(x) // PROBE_QUERIES))[: len(asked)]] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(NEAREST, len(x) - 1)]
    rank = np.argsort(np.argsort(-(asked @ q.centres.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(rank, q.assign(x)[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(PROBED_SHARE * len(needed)))]) + 1 if len(needed) else 1


def _best(found: list[np.ndarray]) -> list[np.ndarray]:
    """The RERANK best guesses of each query: q1, q2, k1, k2, guess."""
    order = np.lexsort((-found[4], found[1], found[0]))
    found = [c[order] for c in found]
    new = np.r_[True, (np.diff(found[0]) != 0) | (np.diff(found[1]) != 0)]
    nth = np.arange(len(new)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return [c[nth < RERANK] for c in found]


def _usable(vectors: DataFrame, vector: str) -> DataFrame:
    v = F.col(vector)
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.coalesce(fine, F.lit(False)))


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    x = np.array(vectors.tolist(), np.float64).reshape(len(vectors), -1)
    return np.pad(x, ((0, 0), (0, dim - x.shape[1])))


def _block_products(entries: DataFrame, questions: DataFrame, dim: int, nearest: int) -> DataFrame:
    """(q1, q2, k1, k2): of every block of entries, each query's best by the plain product, with a few more for rounding. Work is queries times entries."""
    blocks = max(1, -(-entries.count() // PIECE))
    groups = max(1, -(-questions.count() // QUERY_GROUP))
    held = entries.withColumn("piece", F.pmod(F.xxhash64("k1", "k2"), F.lit(blocks))).groupBy("piece").agg(F.collect_list(F.struct("k1", "k2", "v")).alias("held"))
    asking = questions.withColumn("group", F.pmod(F.xxhash64("k1", "k2"), F.lit(groups))).groupBy("group").agg(F.collect_list(F.struct("k1", "k2", "v")).alias("asking"))
    dealt = asking.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for asked, own in zip(pdf["asking"], pdf["held"]):
                scores = _matrix(pd.Series([a["v"] for a in asked]), dim) @ _matrix(pd.Series([h["v"] for h in own]), dim).T
                keep = min(nearest + 9, len(own))
                best = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
                ids = lambda rows, k: np.array([r[k] for r in rows], np.int64)
                yield pd.DataFrame({"q1": np.repeat(ids(asked, "k1"), keep), "q2": np.repeat(ids(asked, "k2"), keep), "k1": ids(own, "k1")[best].ravel(), "k2": ids(own, "k2")[best].ravel(), "guess": np.take_along_axis(scores, best, axis=1).ravel()})

    return dealt.join(held, "piece").mapInPandas(scan, "q1 long, q2 long, k1 long, k2 long, guess double")


def search(vectors: DataFrame, is_query, nearest: int = NEAREST, vec_id: str = "vec_id", vector: str = "embedding", exact: bool = False) -> DataFrame:
    """The ``nearest`` rows found for each query row: query_id, rank, vec_id, score.

    ``exact`` compares every query with every entry, block by block, instead of
    through the index.

    ``is_query`` is a condition on rows; candidates are all rows but the query
    itself, equal vectors included. Order is by exact inner product in double
    precision, then smaller id. Null, zero, partly null and non-finite vectors
    take no part, nor do null ids or vectors of another length than the most
    common one. Repeated rows count once; an empty table gives an empty
    result; other columns are ignored.
    """
    rows = _usable(vectors.where(F.col(vec_id).isNotNull()), vector)
    rows = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64("v", F.lit(3)))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    spark = vectors.sparkSession
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = sizes[0]["dim"]
    rows = rows.where(F.size("v") == dim)
    # of equal vectors the smallest ids are enough: a query leaves out one at most
    alike = Window.partitionBy("k1", "k2").orderBy("id")
    first = rows.select("k1", "k2", "id", "v").dropDuplicates(["k1", "k2", "id"]).withColumn("nth", F.row_number().over(alike)).where(F.col("nth") <= nearest + 1)
    first = stage_table(first, "copies")
    copies = first.select("k1", "k2", "id")
    entries = stage_table(first.where("nth = 1").select("k1", "k2", "v"), "entries")
    asked = stage_table(rows.where("q").select("id", "k1", "k2").distinct(), "asked")

    distinct_asked = asked.select("k1", "k2").distinct()
    questions = stage_table(entries.join(distinct_asked, ["k1", "k2"]), "questions")
    if exact:
        guessed = _block_products(entries, questions, dim, nearest)
        return _ranked(guessed, nearest + 9, entries, questions, copies, asked, nearest)

    sample = entries.orderBy("k1", "k2").limit(FIT_ROWS).toPandas()
    padded = dim + -dim % BLOCK
    model = spark.sparkContext.broadcast(fit(_matrix(sample["v"], dim), entries.count()))

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = model.value
        for pdf in frames:
            if len(pdf):
                x = _matrix(pdf["v"], padded)
                at = q.assign(x)
                coded = [q.encode(x[s], at[s]) for s in _steps(len(x), q.books.shape[0] * WORDS, CELLS)]
                codes, scale = np.concatenate([c.astype(np.uint8) for c, _ in coded]), np.concatenate([s for _, s in coded])
                codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
                packed = codes[:, 0::2] << 4 | codes[:, 1::2]  # two blocks a byte
                yield pd.DataFrame({"file": at.astype(np.int32), "k1": pdf["k1"], "k2": pdf["k2"], "scale": scale, "code": [c.tobytes() for c in packed]})

    coded = stage_table(entries.mapInPandas(index, "file int, k1 long, k2 long, scale double, code binary"), "coded")
    files = coded.groupBy("file").agg(F.count("*").alias("n"))
    salted = coded.join(small(stage_table(files, "files")), "file").withColumn("piece", F.pmod(F.xxhash64("k1", "k2"), F.ceil(F.col("n") / PIECE)))
    pieces = salted.groupBy("file", "piece").agg(F.collect_list(F.struct("k1", "k2", "scale", "code")).alias("held"))

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = model.value
        for pdf in frames:
            if len(pdf):
                best = q.probed(_matrix(pdf["v"], padded))
                n = best.shape[1]
                for s in _steps(len(pdf), n, SENT):
                    some = pdf.iloc[s]
                    yield pd.DataFrame({"file": best[s].ravel().astype(np.int32), "q1": np.repeat(some["k1"].to_numpy(), n), "q2": np.repeat(some["k2"].to_numpy(), n), "v": [v for v in some["v"] for _ in range(n)]})

    # queries keep to one lot in all files that they probe; large lots, since every one has its pieces sent
    many, tasks = questions.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    lots = max(1, -(-many // LOT), min(tasks, many // 64))
    probed = questions.mapInPandas(probe, "file int, q1 long, q2 long, v array<float>").withColumn("lot", F.pmod(F.xxhash64("q1", "q2"), F.lit(lots)))
    probed = probed.withColumn("part", F.pmod(F.xxhash64("q2", "q1"), F.lit(max(1, -(-many // (lots * QUERY_GROUP))))))
    asking = probed.groupBy("file", "lot").agg(F.collect_list(F.struct("q1", "q2", "v", "part")).alias("asking"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # lists stay Arrow arrays: as Python objects they would take many times their size
        q = model.value
        kept: dict[int, list[np.ndarray]] = {}
        lot = None

        def best_of(kept: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for own in kept.values():
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in own], ["q1", "q2", "k1", "k2", "guess"])

        for batch in batches:
            for at, file, asks, holds in zip(batch.column("lot").to_pylist(), batch.column("file").to_pylist(), batch.column("asking"), batch.column("held")):
                if at != lot:
                    yield from best_of(kept)
                    kept, lot = {}, at
                held = holds.values
                codes = np.frombuffer(b"".join(held.field("code").to_pylist()), np.uint8).reshape(len(held), -1)
                part = asks.values.field("part").to_numpy()
                for own in np.unique(part):
                    asked = asks.values.take(pa.array(np.flatnonzero(part == own)))
                    queries = asked.field("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(asked), -1)
                    queries = np.pad(queries, ((0, 0), (0, padded - queries.shape[1])))
                    tables = q.tables(queries)
                    tables = np.pad(tables, ((0, 0), (0, tables.shape[1] % 2), (0, 0)))
                    joint = (tables[:, 0::2, :, None] + tables[:, 1::2, None, :]).reshape(len(queries), -1, WORDS * WORDS)
                    scores = np.zeros((len(queries), len(held)))
                    for b in range(codes.shape[1]):
                        scores += joint[:, b].take(codes[:, b], axis=1)
                    scores = scores * held.field("scale").to_numpy()[None, :] + (queries @ q.centres[file])[:, None]
                    keep = min(RERANK, len(held))
                    best = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
                    found = [np.repeat(asked.field(k).to_numpy(), keep) for k in ("q1", "q2")] + [held.field(k).to_numpy()[best].ravel() for k in ("k1", "k2")]
                    found = [*found, np.take_along_axis(scores, best, axis=1).ravel()]
                    kept[own] = _best([np.concatenate(c) for c in zip(kept[own], found)] if own in kept else found)
        yield from best_of(kept)

    # all files that a query probes come to one task, which passes on each query's best of them all
    met = asking.join(pieces, "file").select("lot", "file", "asking", "held")
    met = met.repartition(tasks, "lot").sortWithinPartitions("lot")
    guessed = met.mapInArrow(scan, "q1 long, q2 long, k1 long, k2 long, guess double")
    return _ranked(guessed, RERANK, entries, questions, copies, asked, nearest)


def _ranked(guessed: DataFrame, rerank: int, entries: DataFrame, questions: DataFrame, copies: DataFrame, asked: DataFrame, nearest: int) -> DataFrame:
    """The answers: each query's ``rerank`` best guesses by their exact product, and equal vectors by id."""
    by_guess = Window.partitionBy("q1", "q2").orderBy(F.desc("guess"), "k1", "k2")
    guessed = stage_table(guessed.withColumn("nth", F.row_number().over(by_guess)).where(F.col("nth") <= rerank).drop("nth", "guess"), "guessed")

    exact = F.aggregate(F.zip_with("a", "b", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = guessed.join(entries.select("k1", "k2", F.col("v").alias("b")), ["k1", "k2"])
    scored = scored.join(small(questions.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("v").alias("a")), 20_000), ["q1", "q2"])
    scored = stage_table(scored.select("q1", "q2", "k1", "k2", exact.alias("score")), "scored")
    by_score = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "id")
    found = scored.join(copies, ["k1", "k2"]).withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") <= nearest + 1)
    found = found.select(F.col("q1").alias("k1"), F.col("q2").alias("k2"), F.col("id").alias("vec_id"), "score")
    answers = asked.withColumnRenamed("id", "query_id").join(found, ["k1", "k2"]).where("query_id != vec_id")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.select("query_id", F.row_number().over(rank).alias("rank"), "vec_id", "score").where(F.col("rank") <= nearest)
