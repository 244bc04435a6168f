"""Search for whole tables of queries: visibility, text match, hybrid scores, rerank,
citations and context packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import terms as T
from ..functions.hooks import ScoreHook
from ..functions.parsing import citation_ids, extract_json_object
from ..functions.text import bind, split_sentences, trim_unicode
from ..functions.vectors import cosine_similarity
from ..session import materialize
from .fuzzy import trigram_text_pairs
from .similarity import MAX_BROADCAST_VALUES, _matrices, bucket_scores, rank_scores, vector_scores, vector_topk

CONTEXT_BUDGET = 24_000
SEPARATOR = "\n\n---\n\n"


def visible(documents: DataFrame, user_id=None) -> DataFrame:
    """Completed documents that are public or owned by the user; without a user, all completed."""
    done = documents.where(F.col("status") == "completed")
    return done if user_id is None else done.where((F.col("access") == "public") | (F.col("owner_id") == user_id))


def visible_counts(documents: DataFrame, users: DataFrame) -> DataFrame:
    """What each of many users may see, without pairing users with public documents: the
    public total is one value, the rest an equi-join on the owner."""
    done = documents.where(F.col("status") == "completed")
    public = done.where(F.col("access") == "public").agg(F.count("*")).scalar()
    own = (done.where(F.col("access") != "public").groupBy(F.col("owner_id").alias("user_id"))
           .agg(F.count("*").alias("own_private")))
    return (users.select("user_id").join(own, "user_id", "left")
            .select("user_id", F.coalesce("own_private", F.lit(0)).alias("own_private"),
                    (F.coalesce("own_private", F.lit(0)) + public).alias("visible")))


def visible_chunks(chunks: DataFrame, documents: DataFrame, user_id=None) -> DataFrame:
    return chunks.join(visible(documents, user_id).select("doc_id"), "doc_id", "left_semi")


def drop_boilerplate(chunks: DataFrame, enabled: bool = True) -> DataFrame:
    return chunks.where(~F.coalesce("is_boilerplate", F.lit(False))) if enabled else chunks


def wanted_terms(queries: DataFrame) -> DataFrame:
    return queries.select(F.explode(T.distinct_terms("text")).alias("term")).distinct()


#: Terms of a query batch that may be broadcast.
MAX_BROADCAST_TERMS = 500_000


def _asked_for(rows: DataFrame, queries: DataFrame | None) -> DataFrame:
    """The rows whose term some query has. The terms are broadcast if a count says that they are few; else rows of
    (term, count) are exchanged, never texts."""
    if queries is None:
        return rows
    wanted = wanted_terms(queries)
    few = wanted.limit(MAX_BROADCAST_TERMS + 1).count() <= MAX_BROADCAST_TERMS
    return rows.join(F.broadcast(wanted) if few else wanted, "term", "left_semi")


def term_table(chunks: DataFrame, stop_words: list[str] | None = None, queries: DataFrame | None = None) -> DataFrame:
    """chunks(chunk_id, content), a row a chunk -> chunk_id, length, term, tf, positions. Terms are counted where their
    text stands, so no text is exchanged. With queries(text) only their terms count."""
    toks = chunks.select("chunk_id", T.tokens("content").alias("_t"))
    placed = toks.select("chunk_id", F.size("_t").alias("length"), F.array_sort(
        F.transform("_t", lambda w, i: F.struct(w.alias("term"), (i + 1).alias("pos")))).alias("_s"))
    cut = placed.withColumn("_b", T.run_starts("_s", "term"))
    counted = T.run_lengths("_s", "_b", lambda b, n: F.struct(
        F.get(F.col("_s"), b)["term"].alias("term"), n.cast("long").alias("tf"), F.slice("_s", b + 1, n)["pos"].alias("positions")))
    rows = cut.select("chunk_id", "length", F.explode(counted).alias("_r")).select("chunk_id", "length", "_r.*")
    if stop_words:
        rows = rows.where(~F.col("term").isin(stop_words))
    return _asked_for(rows, queries)


def term_counts(chunks: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """term_table without positions."""
    toks = chunks.select("chunk_id", T.tokens("content").alias("_t"))
    cut = (toks.select("chunk_id", F.size("_t").alias("length"), F.sort_array("_t").alias("_s"))
           .withColumn("_b", T.run_starts("_s")))
    counted = T.run_lengths("_s", "_b", lambda b, n: F.struct(F.get(F.col("_s"), b).alias("term"), n.cast("long").alias("tf")))
    rows = cut.select("chunk_id", "length", F.explode(counted).alias("_r")).select("chunk_id", "length", "_r.*")
    return _asked_for(rows, queries)


def query_terms(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(qid, qkey, _terms) and (qkey, term, n_terms): queries with the same term set share one key, so
    a query text repeated a million times is matched once."""
    keyed = (queries.select("qid", F.sort_array(T.distinct_terms("text")).alias("_terms"))
             .where(F.size("_terms") > 0)
             .withColumn("qkey", F.unhex(F.md5(F.array_join("_terms", " ")))))
    sets = (keyed.select("qkey", "_terms").dropDuplicates(["qkey"])
            .select("qkey", F.size("_terms").alias("n_terms"), F.explode("_terms").alias("term")))
    return keyed, sets


#: Rows (text, term) of a block of texts, queries of a block, pairs looked at in one go, rows of a batch of results.
TEXT_BLOCK, QUERY_BLOCK, PAIR_BLOCK, RESULT_ROWS = 1_000_000, 16_384, 1_000_000, 100_000


def _packed(arrays: list[pa.Array]) -> pa.RecordBatch:
    """The arrays as one value of bytes, which Spark hands on as it is."""
    row = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in arrays],
                                     names=[str(i) for i in range(len(arrays))])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, row.schema) as out:
        out.write_batch(row)
    return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block"])


def _unpacked(block: pa.Scalar) -> list[pa.Array]:
    return [c.flatten() for c in pa.ipc.open_stream(block.as_buffer()).read_next_batch().columns]


def _starts(ids: pa.Array) -> np.ndarray:
    """Whether a row differs from the one before it."""
    if len(ids) < 2:
        return np.ones(len(ids), bool)
    after, before = ids.slice(1), ids.slice(0, len(ids) - 1)
    same = pc.or_kleene(pc.equal(after, before), pc.and_(pc.is_null(after), pc.is_null(before)))
    return np.r_[True, ~pc.fill_null(same, False).to_numpy(zero_copy_only=False)]


def _text_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk_id, term, weight) in order of the chunk -> blocks of whole texts: ids, words in order of the block's
    postings, postings a word, and the postings' texts and weights."""
    def block(rows: pa.Table) -> pa.RecordBatch:
        ids = rows["chunk_id"].combine_chunks()
        fresh = _starts(ids)
        text = np.cumsum(fresh) - 1
        coded = rows["term"].combine_chunks().dictionary_encode()
        word = coded.indices.to_numpy()
        order = np.lexsort((text, word))
        weights = rows["weight"].combine_chunks().to_numpy(zero_copy_only=False)
        return _packed([ids.filter(pa.array(fresh)), coded.dictionary, pa.array(np.bincount(word, minlength=len(coded.dictionary))),
                        pa.array(text[order].astype(np.int32)), pa.array(weights[order])])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= TEXT_BLOCK:
            rows = pa.Table.from_batches(held)
            last = int(np.flatnonzero(_starts(rows["chunk_id"].combine_chunks()))[-1])
            if last:
                yield block(rows.slice(0, last))
            held = rows.slice(last).combine_chunks().to_batches()
    if sum(b.num_rows for b in held):
        yield block(pa.Table.from_batches(held))


def _query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (name, qkey, terms) in order of the key -> blocks: names, names of each set, words, terms of each set, their
    words."""
    for batch in batches:
        for at in range(0, batch.num_rows, QUERY_BLOCK):
            names, keys, terms = batch.slice(at, QUERY_BLOCK).columns
            fresh = _starts(keys)
            sets = terms.filter(pa.array(fresh))
            coded = sets.flatten().dictionary_encode()
            yield _packed([names, pa.array(np.diff(np.r_[np.flatnonzero(fresh), len(names)])), coded.dictionary,
                           pc.list_value_length(sets), coded.indices])


def _ranges(counts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each i, starts[i] and the counts[i] - 1 numbers after it, with i."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[of]


class _Postings:
    """A block of texts: the postings of its words."""

    def __init__(self, block: pa.Scalar) -> None:
        self.ids, self.words, counts, text, weights = _unpacked(block)
        self.counts, self.text, self.weights = (x.to_numpy(zero_copy_only=False) for x in (counts, text, weights))
        self.first = np.cumsum(self.counts) - self.counts
        self.known = self.ids.is_valid().to_numpy(zero_copy_only=False)
        keys = np.repeat(np.arange(len(self.counts), dtype=np.int64), self.counts) * len(self.ids) + self.text
        # A text that comes twice under one id counts as one, found as often as it comes.
        self.keys, self.at, self.copies = np.unique(keys, return_index=True, return_counts=True)

    def matches(self, lengths: np.ndarray, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(set, text, sum of weights) of the sets whose words some text has all. lengths, words: of the sets one by one,
        -1 for a word of no text."""
        ends = np.cumsum(lengths)
        whole = np.logical_and.reduceat(words >= 0, ends - lengths) if len(lengths) else np.zeros(0, bool)
        for one in (True, False):
            sets = np.flatnonzero(whole & ((lengths == 1) == one))
            if not len(sets):
                continue
            of, at = _ranges(lengths[sets], (ends - lengths)[sets])
            terms = words[at]
            terms = terms[np.lexsort((self.counts[terms], of))]  # a set's rarest word first
            size, begin = lengths[sets], np.cumsum(lengths[sets]) - lengths[sets]
            found = np.cumsum(self.counts[terms[begin]])
            cuts = np.searchsorted(found, np.arange(PAIR_BLOCK, found[-1] + PAIR_BLOCK, PAIR_BLOCK), side="left") + 1
            for low, high in zip(np.r_[0, cuts[:-1]], np.minimum(cuts, len(sets))):
                if low < high:
                    yield from self._some(sets[low:high], size[low:high], begin[low:high], terms, one)

    def _some(self, sets, size, begin, terms, one) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        rarest = terms[begin]
        of, at = _ranges(self.counts[rarest], self.first[rarest])
        if one:
            yield sets[of], self.text[at], self.weights[at]
            return
        text = self.text[at]
        # Each copy of a posting stands for one result; the others are found by key.
        good = self.known[text] & np.r_[True, (of[1:] != of[:-1]) | (text[1:] != text[:-1])][:len(of)]
        of, text, sums, copies = of[good], text[good], np.zeros(int(good.sum())), None
        step = 0
        while len(of):
            need = terms[begin[of] + step].astype(np.int64) * len(self.ids) + text
            place = np.minimum(np.searchsorted(self.keys, need), len(self.keys) - 1)
            held = self.keys[place] == need
            of, text, place = of[held], text[held], place[held]
            sums = sums[held] + self.weights[self.at[place]]
            copies = self.copies[place] if copies is None else np.minimum(copies[held], self.copies[place])
            step += 1
            done = size[of] == step
            if done.any():
                n = copies[done]
                yield np.repeat(sets[of[done]], n), np.repeat(text[done], n), np.repeat(sums[done], n)
                of, text, sums, copies = of[~done], text[~done], sums[~done], copies[~done]


def _match_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, chunk_id, sum) of the matches of each pair of blocks (texts, queries)."""
    last, texts = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            block = batch.column(0)[i]
            if last is None or block.as_buffer() != last:
                last, texts = block.as_buffer(), _Postings(block)
            names, shares, words, lengths, refs = _unpacked(batch.column(1)[i])
            shares, lengths = (x.to_numpy(zero_copy_only=False) for x in (shares, lengths))
            known = pc.fill_null(pc.index_in(words, value_set=texts.words), -1).to_numpy(zero_copy_only=False)
            first = np.cumsum(shares) - shares
            for sets, text, sums in texts.matches(lengths, known[refs.to_numpy(zero_copy_only=False)]):
                # A set that many queries share is told to each of them.
                step = max(1, RESULT_ROWS // int(shares[sets].max()))
                for at in range(0, len(sets), step):
                    part = slice(at, at + step)
                    of, name = _ranges(shares[sets[part]], first[sets[part]])
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(name)), texts.ids.take(pa.array(text[part][of])),
                                                      pa.array(sums[part][of])], names=["name", "chunk_id", "_sum"])


def matched_pairs(keyed: DataFrame, name: str, terms: DataFrame) -> DataFrame:
    """(name, chunk_id, text_score): the chunks that hold all terms of the sets keyed(name, qkey, _terms). Texts and queries
    are packed into blocks of bounded size, and each block of texts meets each block of queries in a product of the two
    tables, which neither exchanges nor writes the pairs: these may be as many as the square of the input. terms is read
    twice, so it should be a stored table."""
    weighed = terms.select("chunk_id", "term", T.tf_weight(F.col("tf"), F.col("length")).alias("weight"))
    rows = terms.count()
    parts = max(1, -(-rows // TEXT_BLOCK), min(16, rows // 20_000))
    texts = materialize(weighed.repartition(parts, "chunk_id").sortWithinPartitions("chunk_id").mapInArrow(_text_blocks, "block binary"))
    asked = materialize(keyed.select(name, "qkey", "_terms").repartition("qkey").sortWithinPartitions("qkey")
                        .mapInArrow(_query_blocks, "block binary"))
    met = texts.hint("shuffle_replicate_nl").crossJoin(asked.withColumnRenamed("block", "queries"))
    kinds = (keyed.schema[name].dataType.simpleString(), terms.schema["chunk_id"].dataType.simpleString())
    found = met.mapInArrow(_match_blocks, f"name {kinds[0]}, chunk_id {kinds[1]}, _sum double")
    return found.select(F.col("name").alias(name), "chunk_id", T.squash(F.col("_sum")).alias("text_score"))


def text_match(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """AND match of queries(qid, text) against term_counts(): qid, chunk_id, text_score. The terms are written once, so
    that the texts are read once."""
    keyed, _ = query_terms(queries)
    return matched_pairs(keyed, "qid", materialize(terms.select("chunk_id", "length", "term", "tf")))


def cover_density(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """Minimal covers of all query terms, each worth min(1, 16/width): qid, chunk_id, cover_score.
    terms is term_table(). Positions meet per (chunk, query), which one chunk's length bounds."""
    keyed, sets = query_terms(queries)
    ids = keyed.select("qid", "qkey")
    terms = materialize(terms.select("chunk_id", "length", "term", "tf", "positions"))
    distinct = keyed.dropDuplicates(["qkey"]).withColumn("_key", F.col("qkey"))
    grouped = (matched_pairs(distinct, "_key", terms).select(F.col("_key").alias("qkey"), "chunk_id").join(sets, "qkey")
               .join(terms.select("chunk_id", "term", "positions"), ["chunk_id", "term"]).groupBy("chunk_id", "qkey")
               .agg(F.max("n_terms").alias("_n"), F.collect_list("positions").alias("_lists"))
               .where(F.size("_lists") == F.col("_n")))
    events = F.array_sort(F.flatten(F.transform(
        "_lists", lambda ps, i: F.transform(ps, lambda p: F.struct(p.cast("int").alias("p"), i.alias("t"))))))

    # Walk the positions keeping each term's last one. The smallest of these opens the cover
    # that ends here, and the cover is minimal exactly when that start has moved.
    def step(state: Column, e: Column) -> Column:
        last = F.transform(state["last"], lambda v, i: F.when(i == e["t"], e["p"]).otherwise(v))
        start = F.array_min(last)
        fresh = (start > 0) & (start != state["start"])
        worth = F.least(F.lit(1.0), F.lit(T.COVER_SPAN) / (e["p"] - start + 1))
        return F.struct(last.alias("last"), start.alias("start"),
                        (state["total"] + F.when(fresh, worth).otherwise(0.0)).alias("total"))
    begin = F.struct(F.array_repeat(F.lit(0), F.col("_n")).alias("last"), F.lit(0).alias("start"),
                     F.lit(0.0).alias("total"))
    scored = grouped.select("chunk_id", "qkey",
                            T.squash(F.aggregate(events, begin, step)["total"]).alias("cover_score"))
    return scored.join(ids, "qkey").select("qid", "chunk_id", "cover_score")


def and_score(content: str, terms: str) -> Column:
    """tf_rank where every term occurs, else 0. A substring test, which a match must pass, spares
    most texts from being tokenised."""
    hopeful = bind(F.lower(content), lambda low: F.forall(terms, lambda w: F.contains(low, w)))
    exact = bind(T.tokens(content), lambda toks: F.when(T.match_all(toks, terms), T.tf_rank(toks, terms))
                 .otherwise(F.lit(0.0)))
    return F.when((F.size(terms) > 0) & hopeful, exact).otherwise(F.lit(0.0))


def hybrid_search(queries: DataFrame, chunks: DataFrame, documents: DataFrame, limit: int = 20,
                  min_score: float = 0.3, vector_weight: float = 0.7, text_weight: float = 0.3,
                  user_id=None, filter_boilerplate: bool = True, exclude_self: bool = False,
                  fusion: str = "vector") -> DataFrame:
    """queries(qid, text, emb), chunks(chunk_id, doc_id, content, emb[, is_boilerplate]).

    The best 2*limit vectors per query drive the result and text scores are added to them, so
    only those few chunks are tokenised; the score floor comes after that limit.
    fusion="full_outer" is an extra that also lets text-only matches in."""
    pool = visible_chunks(chunks, documents, user_id)
    if filter_boilerplate and "is_boilerplate" in chunks.columns:
        pool = drop_boilerplate(pool)
    pool = pool.select("chunk_id", "doc_id", "content", "emb")
    near = vector_topk(queries, pool, 2 * limit, exclude_self).select("qid", "chunk_id", "vector_score")
    if fusion == "full_outer":
        matched = text_match(queries, term_counts(pool, queries)).select("qid", "chunk_id")
        # A text match beyond the best vectors has its own cosine, 0 only where it has no usable vector.
        cosine = cosine_similarity("emb", "_qemb")
        matched = (matched.join(near, ["qid", "chunk_id"], "left_anti").join(pool.select("chunk_id", "emb"), "chunk_id")
                   .join(queries.select("qid", F.col("emb").alias("_qemb")), "qid")
                   .select("qid", "chunk_id", F.coalesce(F.nanvl(cosine, F.lit(0.0)), F.lit(0.0)).alias("vector_score")))
        near = near.unionByName(matched)
    wanted = queries.select("qid", F.array_sort(T.distinct_terms("text")).alias("_q"))
    scored = (near.join(pool.select("chunk_id", "doc_id", "content"), "chunk_id").join(wanted, "qid")
              .withColumn("text_score", and_score("content", "_q"))
              .withColumn("combined_score",
                          vector_weight * F.col("vector_score") + text_weight * F.col("text_score"))
              .where(F.col("combined_score") >= min_score))
    order = W.partitionBy("qid").orderBy(F.desc("combined_score"), "chunk_id")
    return (scored.select("qid", "chunk_id", "doc_id", "vector_score", "text_score", "combined_score")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
            .select("qid", "rank", "chunk_id", "doc_id", "vector_score", "text_score", "combined_score"))


def owner_topk(queries: DataFrame, chunks: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """Top k for queries(qid, emb, user_id) of many users at once: public chunks for everybody,
    private ones only inside the owner's bucket."""
    done = documents.where(F.col("status") == "completed").select("doc_id", "access", "owner_id")
    pool = chunks.select("chunk_id", "doc_id", "emb").join(done, "doc_id")
    public = vector_scores(queries, pool.where(F.col("access") == "public"), k)
    private = bucket_scores(
        queries.select("qid", "emb", F.col("user_id").alias("bucket")).where(F.col("bucket").isNotNull()),
        pool.where(F.col("access") != "public").select("chunk_id", "emb", F.col("owner_id").alias("bucket")),
        "bucket", k)
    return rank_scores(public.unionByName(private), k)


class _Weighted:
    """The best pairs of each query so far: those whose highest possible score reaches the limit-th best sure one."""

    def __init__(self, n: int, limit: int) -> None:
        self.limit, self.least, self.kept, self.pending = limit, np.full(n, -np.inf), [], 0

    def add(self, q: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, tri: np.ndarray) -> None:
        reach = high >= self.least[q] - MARGIN
        self.kept.append(tuple(x[reach] for x in (q, ids, low, high, tri)))
        self.pending += int(reach.sum())
        if self.pending > 500_000:
            self.compact()

    def compact(self) -> tuple:
        rows = tuple(np.concatenate(x) for x in zip(*self.kept))
        order = np.lexsort((-rows[2], rows[0]))
        q, ids, low, high, tri = (x[order] for x in rows)
        starts = np.searchsorted(q, np.arange(len(self.least)))
        at = starts + self.limit - 1
        full = at < np.r_[starts[1:], len(q)]
        self.least[full] = np.maximum(self.least[full], low[at[full]])
        reach = high >= self.least[q] - MARGIN
        self.kept, self.pending = [tuple(x[reach] for x in (q, ids, low, high, tri))], 0
        return self.kept[0]


#: Slack of scores that two libraries add up; a block of rows of the weighted search.
MARGIN, WEIGHTED_BLOCK = 1e-6, 512


def _weighted_near(asked: pa.Table, pool: DataFrame, match_threshold: float, trigram_threshold: float, limit: int,
                   weights: tuple[float, float, float]) -> DataFrame:
    """qid, chunk_id, _tri of the pairs above either threshold that can be among the limit best, for a query batch that fits
    into a task. One scan: a chunk's trigrams are taken once and meet all queries in a product. Only a chunk with all
    trigrams of a query can hold all its words, so for the others the text score is known to be 0."""
    w_vec, w_text, w_tri = weights
    shared = pool.sparkSession.sparkContext.broadcast(asked)
    schema = StructType([StructField("qid", from_arrow_type(asked.schema.field("qid").type)), pool.schema["chunk_id"],
                         StructField("low", DoubleType()), StructField("high", DoubleType()), StructField("_tri", DoubleType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.combine_chunks()
        n, qids = table.num_rows, table["qid"].combine_chunks()
        grams = table["grams"].combine_chunks()
        words = pc.unique(grams.flatten())
        q_size = pc.list_value_length(grams).to_numpy(zero_copy_only=False).astype(np.float64)
        marks = _gram_marks(grams, words)
        vectors = {d: (rows, m) for d, rows, m in _unit_rows(table["emb"].combine_chunks())}
        best, arrow = _Weighted(n, limit), to_arrow_schema(schema)
        ids: list = []
        for batch in batches:
            for at in range(0, batch.num_rows, WEIGHTED_BLOCK):
                part = batch.slice(at, WEIGHTED_BLOCK)
                c_size = pc.list_value_length(part.column(2)).to_numpy(zero_copy_only=False).astype(np.float64)
                common = (marks @ _gram_marks(part.column(2), words).T).astype(np.float64)
                union = q_size[:, None] + c_size[None, :] - common
                tri = np.divide(common, union, out=np.zeros_like(common), where=common > 0)
                cosine = np.full(common.shape, -2.0)  # none
                for d, rows, m in _unit_rows(part.column(1)):
                    if d in vectors:
                        cosine[np.ix_(vectors[d][0], rows)] = vectors[d][1] @ m.T
                q, c = np.nonzero((cosine > match_threshold) | (tri > trigram_threshold))
                low = w_vec * np.where(cosine[q, c] < -1.5, 0.0, cosine[q, c]) + w_tri * tri[q, c]
                whole = (common[q, c] == q_size[q]) & (q_size[q] > 0)
                first = len(ids)
                ids.extend(part.column(0).to_pylist())
                best.add(q, first + c, low, low + np.where(whole, w_text, 0.0), tri[q, c])
        if best.kept:
            q, c, low, high, tri = best.compact()
            yield pa.RecordBatch.from_arrays(
                [qids.take(pa.array(q)).cast(arrow.field(0).type), pa.array([ids[i] for i in c], arrow.field(1).type),
                 pa.array(low), pa.array(high), pa.array(tri)], schema=arrow)

    near = pool.select("chunk_id", "emb", T.trigrams("content").alias("grams")).mapInArrow(scan, schema)
    # The same cut once more over what all tasks have kept.
    sure = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("low")))
    near = near.withColumn("_rn", sure)
    least = F.min(F.when(F.col("_rn") == limit, F.col("low"))).over(W.partitionBy("qid"))
    return near.withColumn("_least", least).where(F.col("_least").isNull() | (F.col("high") >= F.col("_least") - MARGIN)).select(
        "qid", "chunk_id", "_tri")


def _gram_marks(grams: pa.Array, words: pa.Array) -> np.ndarray:
    """Rows x words: 1 where the list has the word."""
    out = np.zeros((len(grams), len(words)), np.float32)
    column = pc.fill_null(pc.index_in(grams.flatten(), value_set=words), -1).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(grams)), pc.list_value_length(grams).to_numpy(zero_copy_only=False))
    out[row[column >= 0], column[column >= 0]] = 1
    return out


def _unit_rows(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, unit vectors) of the usable vectors of each length."""
    places = pa.array(np.arange(len(vectors)))
    yield from _matrices(places, vectors)


def hybrid_search_weighted(queries: DataFrame, chunks: DataFrame, match_threshold: float = 0.85,
                           trigram_threshold: float = 0.3, limit: int = 20, access: str = "public",
                           weights: tuple[float, float, float] = (0.6, 0.25, 0.15), max_queries: int = 1024) -> DataFrame:
    """Rows above the vector threshold or, for typos, the trigram one, ordered by a weighted sum.

    A query batch that fits is broadcast and met in one scan (_weighted_near). For larger ones text and trigram
    scores add at most their weights, so per query only vectors within that margin of the limit-th best can reach
    the result; the others are not emitted."""
    w_vec, w_text, w_tri = weights
    pool = chunks.where(F.col("access") == access).select("chunk_id", "content", "emb")
    texts = queries.select("qid", "text", F.col("emb").alias("_qemb"))
    asked = queries.select("qid", "emb", T.trigrams("text").alias("grams")).limit(max_queries + 1).toArrow()
    values = pc.sum(pc.list_value_length(asked["emb"])).as_py() or 0
    if asked.num_rows <= max_queries and values <= MAX_BROADCAST_VALUES:
        found = _weighted_near(asked, pool, match_threshold, trigram_threshold, limit, weights)
        return _ranked_weighted(found, pool, texts, weights, limit)
    near = vector_scores(queries, pool, limit, floor=match_threshold, strict=True,
                         slack=(w_text + w_tri) / w_vec).select("qid", "chunk_id", F.lit(None).cast("double").alias("_tri"))
    alike = (trigram_text_pairs(queries, pool.select(F.col("content").alias("text")), trigram_threshold)
             .select(F.col("left_text").alias("text"), F.col("right_text").alias("content"),
                     F.col("similarity").alias("_tri")))
    close = (texts.select("qid", "text").join(alike, "text")
             .join(pool.select("chunk_id", "content"), "content").select("qid", "chunk_id", "_tri"))
    found = near.unionByName(close).groupBy("qid", "chunk_id").agg(F.max("_tri").alias("_tri"))
    return _ranked_weighted(found, pool, texts, weights, limit)


def _ranked_weighted(found: DataFrame, pool: DataFrame, texts: DataFrame, weights: tuple[float, float, float], limit: int) -> DataFrame:
    """The limit best of found(qid, chunk_id, _tri) by the weighted sum."""
    w_vec, w_text, w_tri = weights
    # Pairs found by their trigrams bring the similarity along; it is computed for the others only.
    overlap = bind(T.trigrams("content"), lambda c: bind(T.trigrams("text"), lambda q: T.trigram_overlap(c, q)))
    scored = (found.join(pool, "chunk_id").join(texts, "qid")
              .withColumn("similarity", cosine_similarity("emb", "_qemb"))
              .withColumn("_q", T.distinct_terms("text"))
              .withColumn("fts_rank", and_score("content", "_q"))
              .withColumn("trgm_score", F.when(F.col("_tri").isNotNull(), F.col("_tri")).otherwise(overlap))
              .withColumn("score", w_vec * F.coalesce("similarity", F.lit(0.0)) + w_text * F.col("fts_rank")
                          + w_tri * F.col("trgm_score")))
    order = W.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    return (scored.select("qid", "chunk_id", "similarity", "fts_rank", "trgm_score", "score")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit))


def rehydrate(citations: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """citations(answer_id, citations array<struct<id,chunk_id,page,confidence>>) with content and
    file names filled in again; order kept, defaults where the chunk is gone."""
    rows = citations.select("answer_id", F.posexplode("citations").alias("pos", "c"))
    known = (chunks.select("chunk_id", "doc_id", "content", F.col("page").alias("_page"))
             .join(documents.select("doc_id", "filename"), "doc_id"))
    item = F.struct(
        "pos", F.coalesce(F.nullif("c.id", F.lit("")), (F.col("pos") + 1).cast("string")).alias("citation_id"),
        F.col("c.chunk_id").alias("chunk_id"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"),
        F.coalesce("content", F.lit("")).alias("content"), F.coalesce("_page", "c.page").alias("page"),
        "filename", F.col("c.confidence").alias("relevance"))
    return (rows.join(known, rows["c.chunk_id"] == known["chunk_id"], "left").drop(known["chunk_id"])
            .groupBy("answer_id").agg(F.array_sort(F.collect_list(item)).alias("sources")))


def keyword_search(chunks: DataFrame, documents: DataFrame, pattern: str, limit: int | None = None) -> DataFrame:
    found = (chunks.where(F.col("content").ilike(pattern)).join(documents.select("doc_id", "filename"), "doc_id")
             .select("chunk_id", "doc_id", "filename", "content"))
    return found.orderBy("chunk_id").limit(limit) if limit else found


def rerank(hits: DataFrame, scorer: ScoreHook | None = None, top_k: int = 5, floor: float = 0.3) -> DataFrame:
    """hits(qid, rank, query_text, content, combined_score, ..). Without a scorer the first top_k
    keep their combined score (no floor); with one, its top_k at or above the floor remain."""
    base = hits.withColumnRenamed("rank", "original_rank")
    if scorer is None:
        return (base.where(F.col("original_rank") <= top_k).withColumn("relevance", F.col("combined_score"))
                .withColumn("rank", F.col("original_rank")))
    order = W.partitionBy("qid").orderBy(F.desc("relevance"), "original_rank")
    return (base.withColumn("relevance", scorer(F.col("query_text"), F.col("content")))
            .withColumn("rank", F.row_number().over(order))
            .where((F.col("rank") <= top_k) & (F.col("relevance") >= floor)))


def number_citations(hits: DataFrame) -> DataFrame:
    order = W.partitionBy("qid").orderBy("rank")
    return hits.withColumn("citation_id", F.row_number().over(order).cast("string"))


def pack_context(hits: DataFrame, budget: int = CONTEXT_BUDGET) -> DataFrame:
    """hits(qid, rank, citation_id, filename[, original_filename], page, content) -> the sources that fit, as
    one text, each under its original name, else its name, else "Unknown"; an empty name counts as
    none. Lengths are positive, so stopping at the first overflow is a running sum within the budget."""
    names = [F.nullif(F.col(c), F.lit("")) for c in ("original_filename", "filename") if c in hits.columns]
    entry = F.concat(F.lit("["), F.col("citation_id"), F.lit("] ("), F.coalesce(*names, F.lit("Unknown")),
                     F.lit(", p."), F.col("page").cast("string"), F.lit(")\n"), F.col("content"))
    order = W.partitionBy("qid").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    kept = (hits.withColumn("_entry", entry).withColumn("_sum", F.sum(F.length("_entry")).over(order))
            .where(F.col("_sum") <= budget))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_entry"))),
                                      lambda r: r["_entry"]), SEPARATOR)
    return kept.groupBy("qid").agg(joined.alias("context"), F.count("*").alias("used"))


def empty_reason(queries: DataFrame, hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Why queries without a hit have none."""
    any_document = documents.select(F.lit(1).alias("one")).limit(1).agg(F.count("*")).scalar()
    return (queries.select("qid").join(hits.select("qid").distinct(), "qid", "left_anti")
            .withColumn("reason", F.when(any_document == 0, "NO_DOCUMENTS").otherwise("NOT_FOUND")))


VERDICT = ("verified boolean, assessment string, verifiedClaims array<string>, removedClaims array<string>, "
           "confidence double, correctedResponse string")


def audit_records(answers: DataFrame, verdict_col: str = "verdict", threshold: float = 0.85) -> DataFrame:
    """answers(answer_id, query, response, verdict text) -> audit rows; an unreadable verdict counts
    as a failed verification."""
    parsed = answers.withColumn("_v", extract_json_object(verdict_col, VERDICT))
    readable = F.col("_v.verified").isNotNull() | F.col("_v.confidence").isNotNull()
    none = F.array().cast("array<string>")
    removed = F.when(readable, F.coalesce("_v.removedClaims", none)).otherwise(none)
    final = F.when(F.size("removed_claims") > 0,
                   F.coalesce(F.nullif("_v.correctedResponse", F.lit("")), F.col("response"))
                   ).otherwise(F.col("response"))
    return (parsed.withColumn("removed_claims", removed)
            .select("answer_id", "query", F.col("response").alias("draft_response"), final.alias("final_response"),
                    F.coalesce(F.col("_v.verified") & (F.col("_v.confidence") >= threshold), F.lit(False))
                    .alias("verified"),
                    F.coalesce("_v.confidence", F.lit(0.0)).alias("confidence"),
                    F.when(readable, F.coalesce("_v.assessment", F.lit(""))).otherwise("Verification failed")
                    .alias("assessment"),
                    F.size("removed_claims").alias("removed"), (F.size("removed_claims") > 0).alias("hallucination")))


def citation_integrity(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answers(answer_id, text), sources(answer_id, citation_id): sentences without a marker and
    markers without a source, per answer."""
    sentences = (answers.select("answer_id", F.explode(split_sentences("text")).alias("sentence"))
                 .where(trim_unicode("sentence") != "")
                 .withColumn("_ids", citation_ids("sentence")))
    counts = sentences.groupBy("answer_id").agg(
        F.count("*").alias("sentences"), F.count_if(F.size("_ids") > 0).alias("cited"))
    markers = sentences.select("answer_id", F.explode(F.array_distinct("_ids")).alias("citation_id")).distinct()
    unknown = (markers.join(sources.select("answer_id", "citation_id"), ["answer_id", "citation_id"], "left_anti")
               .groupBy("answer_id").agg(F.count("*").alias("unknown_ids")))
    return (counts.join(unknown, "answer_id", "left")
            .select("answer_id", "sentences", "cited", F.coalesce("unknown_ids", F.lit(0)).alias("unknown_ids"),
                    F.try_divide("cited", "sentences").alias("cited_rate")))
